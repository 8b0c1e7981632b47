"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, fingerprints, lm_scoring, mixing, near_dedup, pieces, pii, quality, secrets, substring_dedup, suffix_dedup, vector_codes
from .common import documents

QUERIES = {
    "op1_exact_dedup": lambda spark, sf: exact_dedup.exact_dedup(documents(spark, sf)).drop("length"),
    "op2_pii": lambda spark, sf: pii.pii_spans(documents(spark, sf)),
    "op3_lm_scoring": lambda spark, sf: lm_scoring.quality_score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op4_suffix_dedup": lambda spark, sf: suffix_dedup.suffix_dedup(documents(spark, sf)),
    "op5_substring_dedup": lambda spark, sf: substring_dedup.substring_dedup(documents(spark, sf)),
    "op6_mixing": lambda spark, sf: mixing.mix_sources(documents(spark, sf)).drop("source", "times"),
    "op7_near_dedup": lambda spark, sf: near_dedup.near_dedup(documents(spark, sf)),
    "op8_quality": lambda spark, sf: quality.quality_rules(documents(spark, sf)),
    "op9_secrets": lambda spark, sf: secrets.secret_spans(documents(spark, sf)),
    "op10_sentencepiece": lambda spark, sf: pieces.sampled_pieces(documents(spark, sf)).withColumn("ids_hash", F.xxhash64("ids")).drop("ids"),
    "op11_filter_audit": lambda spark, sf: filter_audit.filter_audit(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op12_vector_codes": lambda spark, sf: vector_codes.vector_codes(spark.read.parquet(f"{sf}/embeddings.parquet")),
    "op13_fingerprints": lambda spark, sf: fingerprints.edited_fingerprints(documents(spark, sf)),
}


def _codes_sql() -> str:
    """Rounds of assignment and floored means, spelled out one after another."""
    vectors = """
        v AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
              WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        w AS (SELECT CAST(len(e) / 8 AS BIGINT) AS w FROM v WHERE r = 1),
        c AS MATERIALIZED (SELECT r, p, k, CAST(floor(4096 * CAST(e[p * w + k + 1] AS DOUBLE)) AS BIGINT) AS x FROM v, w, (SELECT unnest(range(8)) AS p), (SELECT unnest(range(w)) AS k FROM w) WHERE len(e) = 8 * w),
        b0 AS MATERIALIZED (SELECT p, r - 1 AS j, k, x FROM c WHERE r <= 16)"""
    nearest = """
        a{n} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'j': j}}) AS m FROM (SELECT c.r, c.p, b.j, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM c JOIN b{n} b ON c.p = b.p AND c.k = b.k GROUP BY ALL) GROUP BY r, p)"""
    means = """
        s{n} AS (SELECT c.p, m.j AS j, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{n} a ON c.r = a.r AND c.p = a.p GROUP BY ALL),
        b{next} AS MATERIALIZED (SELECT b.p, b.j, b.k, coalesce((s - (s % n + n) % n) // n, b.x) AS x FROM b{n} b LEFT JOIN s{n} s ON b.p = s.p AND b.j = s.j AND b.k = s.k)"""
    steps = [vectors]
    for n in range(vector_codes.ROUNDS):
        steps += [nearest.format(n=n), means.format(n=n, next=n + 1)]
    last = vector_codes.ROUNDS
    steps += [nearest.format(n=last), f"""
        h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, j, k)) AS sha FROM b{last}),
        e AS (SELECT r, string_agg(printf('%02x', CAST(m.j AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r)"""]
    return "WITH" + ",".join(steps) + "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM e JOIN v ON e.r = v.r, h"


SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
                100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS c,
                regexp_matches(text, '[#$%&*|]') AS d,
                coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS e
              FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        x AS (SELECT part, good, toxic, [a, b, c, d, e] AS fails, list_sum([a::INT, b::INT, c::INT, d::INT, e::INT]) AS failed FROM f),
        t AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (SELECT [p.i, q.i, r.i, s.i, u.i] AS ord, list_aggregate(list_transform([p.i, q.i, r.i, s.i, u.i], lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order
              FROM t p, t q, t r, t s, t u WHERE len(list_distinct([p.i, q.i, r.i, s.i, u.i])) = 5),
        w AS (SELECT part, filter_order, t.i AS step, ord[t.i] AS letter, good, toxic, failed, fails[ord[t.i]] AS fail, list_bool_or(list_transform(ord[1:t.i - 1], lambda i: fails[i])) AS gone
              FROM (SELECT part, good, toxic, fails, failed FROM x), o, t),
        g AS (SELECT part, filter_order, step, letter,
                count(*) FILTER (NOT coalesce(gone, false) AND NOT fail) AS kept, count(*) FILTER (NOT coalesce(gone, false) AND fail) AS removed,
                count(*) FILTER (coalesce(gone, false) AND fail) AS redundant, count(*) FILTER (fail AND failed = 1) AS unique_fails,
                count(*) FILTER (NOT coalesce(gone, false) AND fail AND good) AS good_lost, count(*) FILTER (NOT coalesce(gone, false) AND fail AND toxic) AS toxic_lost
              FROM w GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
    "op12_vector_codes": _codes_sql(),
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

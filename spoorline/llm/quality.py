"""Operator 8: quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a row of measures. Per language and source, every measure is summed up in a quantile sketch: counts in
cells whose bounds grow by a fixed factor, so that a quantile is right to within that factor, and sketches merge by adding
counts (Spark sums them before the shuffle; one source with a third of all rows is no larger than any other). The thresholds read off the
sketches replace fixed cutoffs: a document fails when a measure lies outside the middle half of its own group by more than
``SLACK`` times that half's spread, so that up to a quarter of bad rows on one side cannot move the cutoff. A group's
quantiles are means of its own, weighed by its rows, and of its language's, weighed as ``LEAN`` rows, which lean on the whole
table likewise; so small groups lean on more without any switch. Joined back, the thresholds filter the documents.

Defined results: null text has no words and fails the base rule; null lang or source is a group of its own; repeated rows
are judged alike; a group without documents that pass the base rule has its language's thresholds; an empty table gives an
empty table; columns of docs that are named like a measure are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, join_small

_SYMBOLS, _WS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A cell spans values of v to v * GROWTH: the sketch's relative error.
GROWTH = 1.02
SLACK, LEAN = 6.0, 50
#: Measures, and the least spread of each: where most documents have none of something, a little of it is no fault.
MEASURES = {"symbol_share": 0.02, "dup_line_share": 0.05, "repeat_share": 0.05, "word_length": 0.5}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, _WS))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
        if len(ids) < n:
            m = len(ids)
            pairs = np.unique(code[:-1] * m + code[1:], return_inverse=True)[1]
            _, where, count = np.unique(pairs[:-1] * m + code[2:], return_inverse=True, return_counts=True)
            twice = count[where] > 1
            cover = np.zeros(n, dtype=bool)
            for k in range(3):
                cover[k : k + n - 2] |= twice
            repeated = int(cover.sum())
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def counts_of(text: pa.Array) -> pa.Array:
    """COUNTS of each text. One text at a time is taken out of Arrow, whatever the batch."""
    found = np.array([measure(x.as_py()) for x in text], dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], names=COUNTS)


def measures(docs: DataFrame, carried: list[str]) -> DataFrame:
    """One row per document: the carried columns in a struct named row, lang, source, the counts, base_failed and MEASURES. Only texts go to Python."""

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
    def counted(text: pa.Array) -> pa.Array:
        return counts_of(text)

    # Else filters are moved below and measure every text once more, in a second worker for each task.
    counted = counted.asNondeterministic()
    m = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), "lang", "source", counted("text").alias("counts")).select("row", "lang", "source", "counts.*")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return m.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    })


def sketch(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts of each cell of the sketch per group: keys, cell, n. Sketches of parts merge by adding n."""
    cell = F.when(F.col(value) <= 1e-9, F.lit(-2000)).otherwise(F.ceil(F.log(F.col(value)) / float(np.log(GROWTH)))).cast("int")
    return rows.groupBy(*keys, cell.alias("cell")).agg(F.count("*").alias("n"))


def quantiles(cells: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """Read quantiles off merged sketches: keys, n_rows and one column per entry of ``at``. At most some 4000 cells a group."""
    w = Window.partitionBy(*keys)
    run = cells.withColumn("below", F.sum("n").over(w.orderBy("cell"))).withColumn("n_rows", F.sum("n").over(w))
    middle = F.when(F.col("cell") <= -2000, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("cell") - 0.5))
    return run.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *(F.min(F.when(F.col("below") >= q * F.col("n_rows"), middle)).alias(name) for name, q in at.items()))


def thresholds(m: DataFrame) -> DataFrame:
    """group (lang and source), then for each measure the least and the greatest value that passes. Groups are those of m."""
    named = F.to_json(F.struct("lang", "source"))
    good = m.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in MEASURES))).alias("x")).select("lang", "source", "x.*")
    fine = checkpoint(sketch(good, ["lang", "source", "measure"]))  # bounded by groups times cells
    read = lambda keys: quantiles(fine.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n")), [*keys, "measure"], {"q1": 0.25, "q3": 0.75})
    groups = m.select("lang", "source").distinct().select("lang", "source", F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    t = groups.alias("g")
    # Nulls are groups too: joins compare null-safely.
    for name, keys in (("a", ["lang", "source"]), ("b", ["lang"]), ("c", [])):
        same = F.col("g.measure") == F.col(f"{name}.measure")
        for k in keys:
            same = same & F.col(f"g.{k}").eqNullSafe(F.col(f"{name}.{k}"))
        t = t.join(read(keys).alias(name), same, "left")

    def leaning(q: str, levels: str) -> Column:
        """A level's quantile and those of wider levels, by rows; null where no level has rows."""
        n, own = F.coalesce(F.col(f"{levels[0]}.n_rows"), F.lit(0)), F.coalesce(F.col(f"{levels[0]}.{q}"), F.lit(0.0))
        return F.col(f"{levels[0]}.{q}") if len(levels) == 1 else (n * own + LEAN * leaning(q, levels[1:])) / (n + LEAN)

    t = t.select("g.lang", "g.source", "g.measure", leaning("q1", "abc").alias("q1"), leaning("q3", "abc").alias("q3"))
    floor = F.element_at(F.create_map(*(F.lit(x) for kv in MEASURES.items() for x in kv)), F.col("measure"))
    spread = SLACK * F.greatest(F.col("q3") - F.col("q1"), floor)
    t = t.withColumn("t", F.struct((F.col("q1") - spread).alias("least"), (F.col("q3") + spread).alias("most")))
    return t.groupBy(named.alias("group")).agg(*(F.max(F.when(F.col("measure") == k, F.col("t"))).alias(f"t_{k}") for k in MEASURES))


def judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """measures() with kept. What is carried besides doc_id stays in its rows: documents are then measured twice instead of shuffled."""
    m = measures(docs, carried)
    if carried == ["doc_id"]:
        m = checkpoint(m)
    t = thresholds(m if carried == ["doc_id"] else checkpoint(measures(docs, ["doc_id"])))
    beyond = F.lit(False)
    for k in MEASURES:
        beyond = beyond | F.coalesce((F.col(k) > F.col(f"t_{k}.most")) | (F.col(k) < F.col(f"t_{k}.least")), F.lit(False))
    return join_small(m.withColumn("group", F.to_json(F.struct("lang", "source"))), t, ["group"], "left").withColumn("kept", ~F.col("base_failed") & ~beyond)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""
    return judged(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"]).select("row.doc_id", *COUNTS[:-1], "base_failed", "kept", *MEASURES)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their own columns. Nothing but the thresholds is shuffled."""
    return judged(docs, docs.columns).where("kept").select("row.*")

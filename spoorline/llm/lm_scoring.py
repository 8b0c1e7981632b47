"""Operator 3: language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents (the background), share one vocabulary and one
inventory of bigrams. Every token of a document gets a loss from both; the mean difference is the document's score, and
lower means more like the target.

Counts cover every token of every document, and every word and every bigram counts in the scores, whatever its share of the
corpus. Documents are dealt into blocks by their content. A block sends each of its words and bigrams once, with its counts
there, to where all blocks' counts of it are summed up, and gets the sums back in the order in which it asked; no model is
held in one place or broadcast. Messages name their words once and bigrams by places in that list. All of it is one query, so
that texts and bigrams are shuffled once and read again from there. Bigrams are smoothed by absolute discounting, with
exactly the mass that is left going to the unigrams. Target documents are scored like all others, by models that they are
part of. ``models`` makes bounded models in memory instead, on request.

Defined results: null and empty texts have no tokens and null losses and score; without target documents the target model
is uniform; repeated rows each count and score alike; null doc_ids are never targets; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_small, mix, shuffle_partitions, word_bounds, word_hashes
from .near_dedup import slices

DISCOUNT = 0.75
#: Distinct entries that a task holds before it hands its counts on.
HELD = 2_000_000
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _counted(batches, codes) -> Iterator[pa.RecordBatch]:
    """Counts (code, all, target) of a task. codes(raw, at) -> codes and the row of each."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        code, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([h[i] for h in held]), len(code)).astype(np.int64) for i in (1, 2)]
        return code, *sums

    def said(x):
        return pa.RecordBatch.from_arrays([pa.array(y) for y in x], names=["code", "n_all", "n_target"])

    for batch in batches:
        target = batch["target"].to_numpy(zero_copy_only=False)
        for a, raw, at in slices(batch["text"]):
            code, row = codes(raw, at)
            if len(code):
                u, back = np.unique(code, return_inverse=True)
                held.append((u, np.bincount(back, minlength=len(u)), np.bincount(back, target[a + row], len(u)).astype(np.int64)))
            if sum(len(h[0]) for h in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield said(held[0])
                    held = []
    if held:
        yield said(merged())


def _rows_of(first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, dtype=np.int64)


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = word_bounds(raw, at)
    return word_hashes(raw, start, end).view(np.int64), _rows_of(first, len(start))


class Vocabulary:
    """Numbers of words by hash: 1.. for known ones, 0 for unknown ones; len(self) - 1 stands before the first word of a text."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __len__(self) -> int:
        return len(self.hashes) + 2

    def pairs(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word before, the word and the row of every token."""
        h, row = _words(raw, at)
        word = np.zeros(len(h), dtype=np.int64)
        if len(self.hashes):
            i = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
            word = np.where(self.hashes[i] == h, i + 1, 0)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[np.append(True, row[1:] != row[:-1])[: len(row)]] = len(self) - 1
        return before, word, row


class Bigrams:
    """An interpolated bigram model over a shared inventory."""

    def __init__(self, v: int, words: np.ndarray, contexts: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        """words: counts by number (the start of a text never follows). contexts: counts as first word. codes: sorted, first * v + second."""
        self.v, self.codes = v, codes
        self.unigram = (words[: v - 1] + 1.0) / (words[: v - 1].sum() + v - 1)
        first, second = codes // v, codes % v
        own = np.maximum(counts - DISCOUNT, 0.0) / np.maximum(contexts[first], 1.0)
        self.left = 1.0 - np.bincount(first, own, v)
        self.prob = own + self.left[first] * self.unigram[second]

    def losses(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        code = before * self.v + word
        p = self.left[before] * self.unigram[word]
        if len(self.codes):
            i = np.searchsorted(self.codes, code).clip(max=len(self.codes) - 1)
            p = np.where(self.codes[i] == code, self.prob[i], p)
        return -np.log(p)


def models(docs: DataFrame, word_share: float, bigram_share: float) -> tuple[Vocabulary, Bigrams, Bigrams]:
    """Vocabulary, target model and background model of docs (text, target boolean)."""
    schema = "code long, n_all long, n_target long"

    def summed(codes) -> DataFrame:
        return docs.select("text", "target").mapInArrow(lambda b: _counted(b, codes), schema).groupBy("code").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))

    words = checkpoint(summed(_words))
    n_all, n_target = (int(x or 0) for x in words.agg(F.sum("n_all"), F.sum("n_target")).first())
    keep = (F.col("n_all") >= word_share * n_all) | ((F.col("n_target") >= word_share * n_target) & (F.col("n_target") > 0))
    known = words.where(keep).toPandas().sort_values("code")  # at most 2 / word_share rows
    vocabulary = Vocabulary(known["code"].to_numpy(dtype=np.int64))
    v = len(vocabulary)

    def coded(raw, at):
        before, word, row = vocabulary.pairs(raw, at)
        return before * v + word, row

    pairs = checkpoint(summed(coded))
    contexts = pairs.groupBy(F.expr(f"code div {v}").alias("first")).agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")).toPandas()  # at most v rows
    keep = (F.col("n_all") >= bigram_share * n_all) | ((F.col("n_target") >= bigram_share * n_target) & (F.col("n_target") > 0))
    kept = pairs.where(keep).toPandas().sort_values("code")  # at most 2 / bigram_share rows
    out = []
    for name, total in (("n_target", n_target), ("n_all", n_all)):
        count = np.zeros(v)
        count[1 : v - 1] = known[name]
        count[0] = total - count.sum()
        first = np.zeros(v)
        first[contexts["first"].to_numpy(dtype=np.int64)] = contexts[name]
        out.append(Bigrams(v, count, first, kept["code"].to_numpy(dtype=np.int64), kept[name].to_numpy(dtype=np.float64)))
    return vocabulary, *out


#: Bytes of text that a block may hold, some 3 million words; blocks are what a task looks up at once.
BLOCK = 16 << 20
#: Blocks for each place where bigrams are summed up.
BLOCKS_A_PLACE = 2
_MOVED = "kind string, dest long, source long, n long, blob binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length in as few bytes a number as they need, byte by byte, compressed."""
    parts = [np.array([len(columns[0]), len(columns)], dtype=np.int64).tobytes()]
    for c in columns:
        c = c.astype(np.uint64)
        most = int(c.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
        narrow = c.astype(f"<u{width}").view(np.uint8).reshape(len(c), width)
        parts += [bytes([width]), np.ascontiguousarray(narrow.T).tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n, k = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
    out, at = [], 16
    for _ in range(k):
        width = raw[at]
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.uint64))
        at += 1 + n * width
    return out


def _counts(blob: bytes) -> list[np.ndarray]:
    return [c.view(np.int64) for c in _unpack(blob)]


def _moved(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _MOVED.split(", ")])


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    return (codes % np.uint64(parts)).astype(np.int64)


def _split(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    at = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(part[a]), slice(a, b)


def _in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """The rows (doc_id, text and others) by block of their content, as compressed batches: block, rows."""
    names = docs.columns

    def packed(batches):
        for batch in batches:
            block, rows = batch["block"].to_numpy(), batch.select(names)
            order = np.argsort(block, kind="stable")
            said = []
            for b, run in _split(block[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(rows.take(pa.array(order[run])))
                said.append((b, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in said], pa.int64()), pa.array([x[1] for x in said], pa.binary())], names=["block", "rows"])

    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(packed, "block long, rows binary")


#: Stands before the first word of a text; as a word it has no counts.
START = np.uint64(0)


class _Block:
    """The texts of a block as words and pairs of words, each once and in an order that depends on nothing but what they are."""

    def __init__(self, table: pa.Table, parts: int, places: int, pairs: bool = True):
        self.number = table["block"][0].as_py()
        self.rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]]).combine_chunks()
        word, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, raw, at in slices(self.rows["text"]):
            h, r = _words(raw, at)
            word.append(h.view(np.uint64))
            row.append(r + a)
        self.row = np.concatenate(row)
        words, at = np.unique(np.concatenate([*word, np.array([START])]), return_inverse=True)
        start, at = at[-1], at[:-1]
        self.hash = words
        part = _part(words, parts)
        self.word_order = np.argsort(part, kind="stable")
        self.word_part = part[self.word_order]
        self.at = at
        self.opens = np.append(True, self.row[1:] != self.row[:-1])[: len(self.row)]
        self.closes = np.append(self.row[1:] != self.row[:-1], True)[: len(self.row)]
        if not pairs:
            return
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[self.opens] = start
        code, pair = np.unique(before * len(words) + at, return_inverse=True)
        first, second = code // len(words), code % len(words)
        place = _part(_code(words[first], words[second]), places)
        order = np.argsort(place, kind="stable")
        self.place, self.first, self.second = place[order], first[order], second[order]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.pair = back[pair]  # of each token

    def target(self) -> np.ndarray:
        return self.rows["target"].to_numpy()[self.row].astype(np.float64)


def _code(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(first + np.uint64(0x9E3779B97F4A7C15)) + second)


def _ask_pairs(table: pa.Table, parts: int, places: int) -> pa.Table:
    """Counts of a block's pairs of words, sent to where each is summed up: the words in them, then pairs by their places there."""
    x = _Block(table, parts, places)
    n, t = np.bincount(x.pair, minlength=len(x.first)), np.bincount(x.pair, x.target(), len(x.first))
    out = []
    for p, s in _split(x.place):
        names, at = np.unique(np.concatenate([x.first[s], x.second[s]]), return_inverse=True)
        m = s.stop - s.start
        named = _pack(np.diff(x.hash[names], prepend=np.uint64(0)))
        out.append(("pair", p, x.number, m, len(named).to_bytes(8, "little") + named + _pack(np.diff(at[:m], prepend=0), at[m:], n[s], t[s])))
    return _moved(out)


def _asked_pairs(rows: list[dict], which: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Of all pairs asked for: 0 code, 1 first word, 2 count, 3 count in targets."""
    out: list[list[np.ndarray]] = [[] for _ in which]
    for r in rows:
        cut = 8 + int.from_bytes(r["blob"][:8], "little")
        (names,) = _unpack(r["blob"][8:cut])
        names = np.cumsum(names, dtype=np.uint64)
        first, second, n, t = _counts(r["blob"][cut:])
        first = names[np.cumsum(first)]
        own = (_code(first, names[second]), first, n, t)
        for have, i in zip(out, which, strict=True):
            have.append(own[i])
    return tuple(np.concatenate(c) for c in out)


def _sum_pairs(table: pa.Table) -> pa.Table:
    """Whole counts of pairs, back to each block that asked."""
    rows = table.to_pylist()
    code, n, t = _asked_pairs(rows, (0, 2, 3))
    of = np.unique(code, return_inverse=True)[1]
    n, t = (np.bincount(of, c).astype(np.int64) for c in (n, t))
    out, a = [], 0
    for r in rows:
        mine = of[a : a + r["n"]]
        a += r["n"]
        out.append(("counts", r["source"], r["dest"], r["n"], _pack(n[mine], t[mine])))
    return _moved(out)


def _count_followers(table: pa.Table, parts: int) -> pa.Table:
    """How many different words follow each word, of the pairs that are summed up here."""
    code, first, t = _asked_pairs(table.to_pylist(), (0, 1, 3))
    _, at, of = np.unique(code, return_index=True, return_inverse=True)
    words, who = np.unique(first[at], return_inverse=True)
    follow, follow_t = np.bincount(who), np.bincount(who, np.bincount(of, t) > 0).astype(np.int64)
    part = _part(words, parts)
    order = np.argsort(part, kind="stable")
    return _moved([("follow", p, -1, s.stop - s.start, _pack(np.diff(words[order][s], prepend=np.uint64(0)), follow[order][s], follow_t[order][s])) for p, s in _split(part[order])])


def _ask_words(table: pa.Table, parts: int) -> pa.Table:
    """Counts of a block's words, sent to where each is summed up: as words, and as last words, which nothing follows."""
    x = _Block(table, parts, 1, False)
    t = x.target()
    size = len(x.hash)
    counts = [np.bincount(x.at, minlength=size), np.bincount(x.at, t, size), np.bincount(x.at[x.closes], minlength=size), np.bincount(x.at[x.closes], t[x.closes], size)]
    # The start is no word: here stands how many texts it begins.
    at = int(np.searchsorted(x.hash, START))
    counts[2][at], counts[3][at] = x.opens.sum(), t[x.opens].sum()
    order = x.word_order
    return _moved([("word", p, x.number, s.stop - s.start, _pack(np.diff(x.hash[order][s], prepend=np.uint64(0)), *(c[order][s] for c in counts))) for p, s in _split(x.word_part)])


def _sum_words(table: pa.Table) -> pa.Table:
    """Whole counts of words, back to each block that asked, and the sums over all words here (kinds all, target, known)."""
    rows = table.to_pylist()
    asked, follow = ([r for r in rows if r["kind"] == k] for k in ("word", "follow"))
    got = [[_unpack(r["blob"]) for r in x] for x in (asked, follow)]
    word, other = (np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(c[0], dtype=np.uint64) for c in g)]) for g in got)
    w, f = ([np.concatenate([np.zeros(0, np.int64), *(c[i].view(np.int64) for c in g)]) for i in range(1, k)] for g, k in zip(got, (5, 3), strict=True))
    code, of = np.unique(np.append(word, other), return_inverse=True)
    m = len(word)
    sums = [np.bincount(of[:m], x, len(code)).astype(np.int64) for x in w] + [np.bincount(of[m:], x, len(code)).astype(np.int64) for x in f]
    out, a = [], 0
    for r in asked:
        mine = of[a : a + r["n"]]
        a += r["n"]
        out.append(("words", r["source"], r["dest"], r["n"], _pack(*(x[mine] for x in sums))))
    return _moved([*out, *((k, -1, -1, int(v), None) for k, v in (("all", sums[0].sum()), ("target", sums[1].sum()), ("known", (sums[0] > 0).sum())))])


def _scored(table: pa.Table, replies: pa.Table, parts: int, places: int) -> pa.Table:
    names, types = [x.split()[0] for x in SCORES.split(", ")], [pa.int64(), pa.int64(), *[pa.float64()] * 3]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in types], names=names)
    x = _Block(table, parts, places)
    rows = sorted(replies.to_pylist(), key=lambda r: r["source"])
    got = {kind: [np.concatenate(c) for c in zip(*[[np.zeros(0, np.int64)] * k, *(_counts(r["blob"]) for r in rows if r["kind"] == kind)], strict=True)] for kind, k in (("counts", 2), ("words", 6))}
    assert len(got["counts"][0]) == len(x.first) and len(got["words"][0]) == len(x.hash)
    totals = next(({k: r[k] for k in ("target", "all", "known")} for r in rows if r["kind"] == "words"), None)
    back = np.empty_like(x.word_order)
    back[x.word_order] = np.arange(len(x.word_order))
    first, second = back[x.first], back[x.second]
    size = x.rows.num_rows
    n = np.bincount(x.row, minlength=size)
    start = int(back[np.searchsorted(x.hash, START)])
    means = []
    for m, name in ((1, "target"), (0, "all")):
        word = got["words"][m]
        context = word - got["words"][2 + m]
        context[start] = got["words"][2 + m][start]
        context, follow = context[first], got["words"][4 + m][first]
        left = np.where(context > 0, DISCOUNT * follow / np.maximum(context, 1), 1.0)
        p = np.maximum(got["counts"][m] - DISCOUNT, 0.0) / np.maximum(context, 1) + left * (word[second] + 1.0) / (totals[name] + totals["known"] + 1) if len(first) else np.zeros(0)
        means.append(np.bincount(x.row, -np.log(p)[x.pair], size) / np.maximum(n, 1))
    t, b = means
    return pa.table([x.rows["doc_id"], pa.array(n), *(pa.array(y, mask=n == 0) for y in (t, b, t - b))], names=names).cast(pa.schema(list(zip(names, types, strict=True))))


def whole_score(marked: DataFrame) -> DataFrame:
    """SCORES of rows (doc_id, text, target) by models that keep every word and every bigram.

    The exchange of texts serves three readers and that of pairs two; nothing is collected. The three sums over all words
    are one row, which is sent to all.
    """
    size = marked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(marked.sparkSession), -(-size // BLOCK))
    places = max(1, parts // BLOCKS_A_PLACE)
    blocks = _in_blocks(marked, parts)
    ask_pairs, ask_words = (lambda t: _ask_pairs(t, parts, places)), (lambda t: _ask_words(t, parts))
    pairs = blocks.groupBy("block").applyInArrow(ask_pairs, _MOVED)
    followers = pairs.groupBy("dest").applyInArrow(lambda t: _count_followers(t, parts), _MOVED)
    counts = pairs.groupBy("dest").applyInArrow(_sum_pairs, _MOVED)
    words = blocks.groupBy("block").applyInArrow(ask_words, _MOVED).unionByName(followers).groupBy("dest").applyInArrow(_sum_words, _MOVED)
    totals = words.agg(*(F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("all", "target", "known")))
    none = [F.lit(None).cast("long").alias(k) for k in ("all", "target", "known")]
    replies = words.where("kind = 'words'").join(F.broadcast(totals)).unionByName(counts.select("*", *none))
    return blocks.groupBy("block").cogroup(replies.groupBy("dest")).applyInArrow(lambda t, r: _scored(t, r, parts, places), SCORES)


def score(docs: DataFrame, target_ids: DataFrame, word_share: float = 0.0, bigram_share: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, both losses a token and their difference, for every document. target_ids: doc_ids of target documents.

    A share above 0 asks for models() without the entries below it.
    """
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = join_small(rows, ids, ["doc_id"], "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    if word_share <= 0 and bigram_share <= 0:
        return whole_score(marked)
    shared = docs.sparkSession.sparkContext.broadcast(models(marked, word_share, bigram_share))

    def losses(batches):
        vocabulary, target, background = shared.value
        for batch in batches:
            for a, raw, at in slices(batch["text"]):
                before, word, row = vocabulary.pairs(raw, at)
                n = np.bincount(row, minlength=len(at) - 1)
                t, b = (np.bincount(row, m.losses(before, word), len(at) - 1) for m in (target, background))
                some = n > 0
                with np.errstate(invalid="ignore", divide="ignore"):
                    columns = [pa.array(x, mask=~some) for x in (t / n, b / n, (t - b) / n)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(n)), pa.array(n.astype(np.int64)), *columns], names=[x.split()[0] for x in SCORES.split(", ")])

    return rows.mapInArrow(losses, SCORES)


def quality_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score() with the documents labelled as good ones for a target."""
    return score(docs, labels.where("quality = 1"))

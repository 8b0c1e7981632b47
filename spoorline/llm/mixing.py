"""Operator 6: mix sources to target weights by Pareto order sampling.

Targets: every source has a weight; shares of the wanted size are capped at ``cap`` times the source's size and the excess
is dealt to the others by weight. The water level is found with one pass over the sources sorted by size over weight.

Sampling: a source that wants r times its size takes floor(r) whole copies of every document. The rest is a sample without
replacement. Documents fall into classes by the binary logarithm of their size; class b has the inclusion odds
c * 2**(-b / 2), so that one very long document does not decide a small source, and c is solved for per source such that
the expected words, the sum of size times inclusion probability, are what is wanted. A document draws u from a hash of its
key and is ranked by (u/(1-u)) / odds. The documents of least rank are taken until their words come nearest to what is left.
No group is sorted whole: the classes' counts give the distribution of the rank, whose quantiles are cells of equal
expected rows at any odds; words are summed per cell, and only inside a cell are rows put in order.

Defined results: null text has size 0; null source is a source of its own, last; documents of size 0 take 0; repeated rows
each count, in any order of equal rows; an empty table gives an empty table; ties in rank go by doc_id, then size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, fresh, join_small

WEIGHTS = (3.0, 1.0, 2.0)
ROWS_PER_CELL = 2_000


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target: one row a source, from rows with source and size.

    The windows without keys run over one row a source, not over documents.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    t = t.withColumn("limit", limit).withColumn("fill", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    above = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
    # The level if all sources from this one on (in order of fill) were below their limits.
    t = t.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(above))
    level = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything)
    t = t.withColumn("level", level)
    return t.select("source", "source_size", "n_docs", F.when(F.col("level").isNull() | (F.col("fill") < F.col("level")), F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def with_sizes(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *columns)


def size_class() -> Column:
    return F.floor(F.log2(F.col("size") + 1.0)).cast("int")


def class_weight(b: Column) -> Column:
    return F.pow(F.lit(2.0), -b / 2.0)


def calibrated(sizes: DataFrame, t: DataFrame) -> DataFrame:
    """t with copies, left (words wanted beyond them), scale (c of the odds) and bins (rows and words by size class)."""
    by = sizes.groupBy("source", size_class().alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    bins = by.groupBy("source").agg(F.collect_list(F.struct("n", "words", class_weight(F.col("b")).alias("w"))).alias("bins"))  # at most 64 a source
    t = t.alias("t").join(bins.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select("t.*", "b.bins")
    t = t.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))

    def expected(c: Column) -> Column:
        return F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + x["words"] * (c * x["w"]) / (1 + c * x["w"]))

    def halve(r: Column, _: Column) -> Column:
        mid = (r["lo"] + r["hi"]) / 2
        high = expected(F.exp(mid)) > F.col("left")
        return F.struct(F.when(high, r["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(r["hi"]).alias("hi"))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-40.0).alias("lo"), F.lit(60.0).alias("hi")), halve)
    return t.withColumn("scale", F.exp(solved["lo"]))


def pareto_take(sizes: DataFrame, t: DataFrame, seed: int = 20) -> DataFrame:
    """Rows of sizes (doc_id, source, size, ...) with source_size, target, odds, rank and taken."""
    t = calibrated(sizes, t).withColumn("cells", (F.lit(1) + F.col("n_docs") / ROWS_PER_CELL).cast("long"))
    key = F.coalesce(F.to_json(F.struct("source")), F.lit(""))
    rows = join_small(sizes.withColumn("__group", key), t.withColumn("__group", key).drop("source"), ["__group"], "left")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = rows.withColumn("odds", F.col("scale") * class_weight(size_class()))
    rows = rows.withColumn("rank", (u / (1 - u)) / F.col("odds"))
    # The share of the source's rows that are expected to rank lower.
    part = lambda x: F.col("rank") * F.col("scale") * x["w"]
    below = F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + x["n"] * part(x) / (1 + part(x))) / F.col("n_docs")
    rows = rows.withColumn("cell", F.least(F.col("cells") - 1, F.floor(below * F.col("cells")))).drop("bins")
    per_cell = rows.groupBy("__group", "cell").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("__group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    starts = per_cell.select("__group", "cell", before)
    w = Window.partitionBy("__group", "cell").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.join(starts, ["__group", "cell"]).withColumn("end", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A document is taken when that brings the words nearer to what is left: its middle lies below it.
    extra = (F.col("end") - F.col("size") / 2.0 < F.col("left")) & (F.col("size") > 0)
    return rows.withColumn("times", F.col("copies") + extra.cast("long")).withColumn("taken", F.col("size") * F.col("times"))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 20) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    sizes = checkpoint(with_sizes(docs))  # three numbers a document
    return pareto_take(sizes, targets(sizes, share, cap, weights), seed).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def mix_repeat(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 20) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with all their columns."""
    row, doc, of, times, n, each, copy = fresh(docs, "row_hash", "doc", "of", "times", "n", "each", "copy")
    key = F.xxhash64("source", "text")
    sizes = checkpoint(with_sizes(docs, key.alias("row_hash")))
    # A row is told from others by its doc_id and the hash of the rest together.
    taken = pareto_take(sizes, targets(sizes, share, cap, weights), seed).groupBy(F.col("doc_id").cast("long").alias(doc), F.col("row_hash").alias(of)).agg(F.sum("times").alias(times), F.count("*").alias(n))
    same = (F.col(row) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc))
    rows = docs.withColumn(row, key).join(taken.where(F.col(times) > 0), same)
    nth = F.row_number().over(Window.partitionBy(doc, row).orderBy(row))
    rows = rows.withColumn(each, F.floor(F.col(times) / F.col(n)) + (nth <= F.col(times) % F.col(n)).cast("long")).where(F.col(each) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).drop(row, doc, of, times, n, each, copy)

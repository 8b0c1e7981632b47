"""Operator 11: how five filters interact, over every order in which they can be applied.

Each document gets a mask of the filters it fails. Masks are counted per part, which leaves at most 32 cells a part whatever
the number of documents. Every cell is then folded over a constant array of all 120 orders by ``transform`` and ``aggregate``:
walking an order from left to right, the fold carries whether the cell's documents are still there and gives one struct of
weighted counts a step, 600 in all. Structs of the same order and step are added up elementwise per part.

Filters (a document fails when): A under 100 words; B 100 * distinct words < 80 * words; C 100 * capital letters A-Z > 10 *
code points; D any of ``#$%&*|``; E its text is that of a smaller doc_id.

Copies are found by digest. Rows of one digest are summed up before they meet, so that a large group of copies is at most one
row a doc_id, and then one row a part, label and mask. Rows without doc_id are dealt over SPREAD keys when labels are joined.

Defined results: null text is empty, null lang the part of the empty string; null doc_ids have no labels, and neither fail E nor make
others fail it; repeated rows of one doc_id count one by one and do not fail E through each other; several labels of one
doc_id count as good or toxic when one of them says so; labels without a document are ignored; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, whole_text

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SPREAD = 64
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures() -> Column:
    """The mask of filters A to D (bit 0 to 3) that a row's text fails; reads the columns text (never null) and words."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    bits = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just these filters."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("text"))
    seen = texts.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"))).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures().alias("mask"))
    rows = seen.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")).withColumn("deal", F.lit(0))
    # A null doc_id matches no label; the second key keeps such rows from meeting in one task.
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0).cast("int"))
    marked = rows.join(known, ["doc_id", "deal"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of each digest one row a part and label: its rows, those of its least doc_id, and those without doc_id.
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic", "doc_id").agg(F.sum("n").alias("n")).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("single", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("single").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("single")).alias("n"))))
    split = groups.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _fold(order: Column) -> Column:
    """One cell walked through one order: an array of a struct a step."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>").alias("out"))

    def step(state: Column, letter: Column) -> Column:
        # Letters are numbers of filters here: bit and filter agree.
        fails, alive = F.get(F.col("bits"), letter), state["alive"]
        weigh = lambda when, weight="n": F.when(when, F.col(weight)).otherwise(zero)
        counts = (weigh(alive & ~fails), weigh(alive & fails), weigh(~alive & fails), weigh(fails & (F.bit_count("mask") == 1)), weigh(alive & fails, "good"), weigh(alive & fails, "toxic"))
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["out"], F.array(F.struct(*(c.alias(name) for c, name in zip(counts, COUNTS, strict=True))))).alias("out"))

    return F.aggregate(order, start, step, lambda s: s["out"])


def interactions(found: DataFrame) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley, from cells()."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    numbers = F.array(*(F.array(*(F.lit(FILTERS.index(c)) for c in o)) for o in orders))
    folded = found.withColumn("bits", F.array(*(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(FILTERS)))))
    folded = folded.select("part", F.posexplode(F.flatten(F.transform(numbers, _fold))).alias("at", "c"))
    merged = folded.groupBy("part", "at").agg(*(F.sum(f"c.{c}").alias(c) for c in COUNTS))
    n = len(FILTERS)
    named = merged.withColumn("filter_order", F.get(F.array(*map(F.lit, orders)), F.floor(F.col("at") / n).cast("int"))).withColumn("step", F.col("at") % n + 1)
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.withColumn("shapley", F.sum("removed").over(own)).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    return interactions(cells(docs, labels))

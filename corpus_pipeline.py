"""A corpus pipeline of five text operators.

Quality rules, exact dedup, MinHash near-dedup (five words, similarity 0.8), mixing sources to target weights (1.5 times
all sizes), and SentencePiece encoding. Every stage works on all that its predecessor kept. Rows repeated by mixing are
encoded as often as they stand there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoorline.llm.common import checkpoint
from spoorline.llm.exact_dedup import exact_filter
from spoorline.llm.mixing import mix_repeat
from spoorline.llm.near_dedup import near_filter
from spoorline.llm.pieces import sampled_pieces
from spoorline.llm.quality import quality_filter

SAMPLES = 2

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_filter(docs)),
    ("exact dedup", lambda spark, docs, sf_dir: exact_filter(docs)),
    ("near dedup", lambda spark, docs, sf_dir: near_filter(docs)),
    ("mixing", lambda spark, docs, sf_dir: mix_repeat(docs)),
    ("sentencepiece", lambda spark, docs, sf_dir: sampled_pieces(docs, k=SAMPLES)),
]

#: Quality sketches, MinHash, order sampling and sampled segmentation have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

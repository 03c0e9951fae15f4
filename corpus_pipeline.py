"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next stage's
docs. ORACLE_SQL is None: neither the classifier nor the tokenizer can be written in SQL, so the tests hold run()
against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, mixing, neardup, pii, quality
from tessella.llm.common import forget, settle, table

STAGES = [
    ("quality", quality.stage),
    ("neardup", neardup.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            forget(before)  # a stage's input goes once its result is written
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of five operators; each stage works on what the one before
wrote. ORACLE_SQL is None: the classifier and the merges have no SQL form; the
tests check the stages against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintner.llm.common import read
from vintner.llm.jaccard_join import keep_first
from vintner.llm.mixing import mix_stage
from vintner.llm.pieces import encode_stage
from vintner.llm.pii import redact_stage
from vintner.llm.quality import filter_stage
from vintner.session import materialize

STAGES = [
    ("quality", filter_stage),
    ("near_duplicates", keep_first),
    ("pii", redact_stage),
    ("mixing", mix_stage),
    ("pieces", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

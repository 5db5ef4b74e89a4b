"""Parquet directory scan (S2) and literal-row frames (S3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from vintner.session import table_path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet file or directory; column pruning and filter pushdown are
    left to Catalyst, so callers should select/filter right after this."""
    return spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the driver tables ``<sf_dir>/<name>.parquet``."""
    return read_parquet(spark, table_path(sf_dir, name))


def frame_from_rows(spark: SparkSession, rows: Sequence[Sequence],
                    schema: StructType | Sequence[str]) -> DataFrame:
    """Build a DataFrame from literal rows. Prefer a ``StructType``: a list of
    names makes Spark infer types from the values, and fails on zero rows."""
    return spark.createDataFrame(list(rows), schema)

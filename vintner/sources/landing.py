"""Idempotent landing (S4): write a frame to a path only if nothing is there yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def is_landed(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its ``_SUCCESS`` mark at ``path``."""
    try:
        spark.read.format("binaryFile").load(f"{path.rstrip('/')}/_SUCCESS")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def land_once(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",") -> str:
    """Land ``df`` at ``path`` unless a finished landing is there; return the path.

    Only the ``_SUCCESS`` mark counts: a folder left by a crashed write is
    written again, a finished one stays untouched. One landing at a time per
    path: check and write are two steps. (A committer that leaves no mark makes
    every call write.)
    """
    if is_landed(df.sparkSession, path):
        return path
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    writer.save(path)
    return path

"""Run logs as partitioned ledgers.

A ledger is a Parquet folder partitioned by the day of its records and by
columns that queries select on (an experiment). A predicate on these prunes
folders before a file is opened; writing some days again replaces those days
only (dynamic partition overwrite): the new files of all partitions are complete
before any old one goes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintner.functions.names import col_of

DAY = "day"


def write_ledger(records: DataFrame, path: str, by: Sequence[str] = (), ts: str = "ts",
                 replace: bool = False) -> str:
    """Write ``records`` under ``path``, partitioned by day of ``ts`` and then
    ``by``; returns the path. Appends; with ``replace`` the partitions that occur
    in ``records`` are replaced and all others stay. Rows without a time go to
    the partition of no day. Rows are first dealt by partition and, within it, by
    a hash of the row, so a partition is written as few files by several tasks,
    and a hot day by many."""
    if DAY in records.columns:
        raise ValueError(f"the column {DAY!r} is the ledger's own")
    parts = [DAY, *by]
    dated = records.withColumn(DAY, col_of(ts).cast("date"))
    salt = F.pmod(F.xxhash64(*map(col_of, records.columns)), F.lit(16))
    writer = dated.repartition(*map(col_of, parts), salt).write.partitionBy(*parts)
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(path)
    return path


def read_ledger(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The records and their day. ``like`` gives the types of the columns, since
    the values of partition columns are text in folder names; without it Spark
    guesses them."""
    if like is None:
        return spark.read.parquet(path)
    schema = like.drop(DAY).schema.add(DAY, "date")
    return spark.read.schema(schema).parquet(path)

"""Run a stateless DataFrame function over a file stream."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def stream_through(spark: SparkSession, source: str, transform: Callable[[DataFrame], DataFrame],
                   sink: str, fmt: str = "parquet") -> DataFrame:
    """Read the Parquet files at ``source`` as a stream, apply ``transform``,
    write to ``sink`` with an ``availableNow`` trigger (all files present now,
    then stop) and return the sink read as a batch frame.

    The checkpoint sits next to the sink on the same shared storage, so a
    restarted query resumes where it stopped and the file sink stays
    exactly-once.
    """
    batch = spark.read.format(fmt).load(source)
    schema = batch.schema
    reader = spark.readStream.schema(schema).format(fmt)
    if source.rstrip("/").endswith(f".{fmt}") and not _is_dir(batch.inputFiles(), source):
        # a file stream source watches a folder: watch the parent, this file only
        folder, name = source.rstrip("/").rsplit("/", 1)
        stream = reader.option("pathGlobFilter", name).load(folder)
    else:
        stream = reader.load(source)
    query = (transform(stream).writeStream.format("parquet")
             .option("path", f"{sink}/data")
             .option("checkpointLocation", f"{sink}/_checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{sink}/data")


def _is_dir(files: list[str], path: str) -> bool:
    """Whether the files that a path stands for lie below it."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return not (len(files) == 1 and unquote(files[0]).rsplit("/", 1)[-1] == name)

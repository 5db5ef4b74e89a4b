"""Position of each row inside its group, by one path for every size.

Rows are range-partitioned by (group, order, hash of the row, place in the input)
and written once with the number of their partition. Rows are counted per (group, partition); a
prefix sum over these few counts gives each partition its offset, and
``row_number`` runs per (group, partition). A group that holds a third of the
table, or rows that share one order value, spread over many partitions; nothing
is sampled, collected or broadcast here. Any orderable type works: nulls come
first, ties take distinct positions by the hash of their row. A null group is a
group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintner.functions.names import col_of
from vintner.session import materialize

_P, _ROW = "_rank_part", "_rank_row"


def sequence_within_groups(df: DataFrame, groups: Sequence[str], order: str,
                           output: str = "seq", base: DataFrame | None = None,
                           dtype: str = "long", partitions: int | None = None) -> DataFrame:
    """Add ``output`` = 1-based position of the row in its group by ``order``.

    ``base`` optionally gives a starting value per group (columns ``groups`` +
    ``base``); positions then continue after it. With no ``groups`` this is a
    global row number. ``partitions`` defaults to the session's shuffle
    partitions. The ranged rows are written to the shared checkpoint folder, so
    the input is read once for the numbers (and sampled once for the ranges).
    """
    keys = [col_of(c) for c in groups]
    tie = F.xxhash64(*[col_of(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    by = [*keys, col_of(order), tie]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are equal in all columns are told apart by their place in the
    # input, so that a large group of them makes no hot range
    placed = df.withColumn(_ROW, F.monotonically_increasing_id())
    ranged = materialize(placed.repartitionByRange(n, *by, F.col(_ROW)).drop(_ROW).withColumn(_P, F.spark_partition_id()), "ranked")
    names = [f"_k{i}" for i in range(len(keys))]
    counts = ranged.groupBy(*[k.alias(a) for k, a in zip(keys, names)], F.col(_P).alias("_kp")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("_kp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if base is not None:
        start = base.select(*[k.alias(f"_b{i}") for i, k in enumerate(keys)], col_of("base").alias("_base"))
        same = F.lit(True)
        for i, a in enumerate(names):
            same = same & F.col(a).eqNullSafe(F.col(f"_b{i}"))
        offsets = offsets.join(start, same, "left").withColumn("_off", F.col("_off") + F.coalesce("_base", F.lit(0)))
    offsets = offsets.select(*names, "_kp", "_off")
    local = F.row_number().over(Window.partitionBy(*keys, _P).orderBy(col_of(order), tie))
    same = F.col(_P) == F.col("_kp")
    for k, a in zip(keys, names):
        same = same & k.eqNullSafe(F.col(a))
    return (ranged.withColumn("_local", local).join(offsets, same)
            .withColumn(output, (F.col("_off") + F.col("_local")).cast(dtype))
            .drop(_P, "_kp", "_off", "_local", *names))

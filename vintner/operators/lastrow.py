"""The last row of every key (J1, R2, R3) by a packed arg-max.

``max_by`` over texts keeps them in its buffer, so Spark sorts every map
partition before it aggregates. Here the order of a row, a time and a tie-break,
is one fixed-width number (``decimal(38)``: microseconds times 2**64 plus the
tie-break, and three bits for a small code), which Spark keeps in a hash map:
``max`` of it is a hash aggregate with 16 bytes per key. What is small travels
in the code; texts are fetched for the winners only, by one join on the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintner.functions.names import col_of

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# microseconds from here are never negative: the first instant of year 1
_FIRST = -62_135_596_800_000_000
CODES = 8


def _whole(df: DataFrame, name: str) -> Column | None:
    """A column as a number >= 0 below 2**64, or None if its type has none."""
    kind = df.schema[name].dataType
    if isinstance(kind, _WHOLE):
        return col_of(name).cast("decimal(38,0)") + F.lit(Decimal(1 << 63))
    day = 86_400_000_000
    if isinstance(kind, T.DateType):
        micros = F.unix_date(col_of(name)).cast("long") * day
    elif isinstance(kind, T.TimestampNTZType):  # by its parts: no time zone has a say
        t = col_of(name)
        second = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
        micros = F.unix_date(t.cast("date")).cast("long") * day + (F.hour(t) * 60 + F.minute(t)).cast("long") * 60_000_000 + second
    elif isinstance(kind, T.TimestampType):
        micros = F.unix_micros(col_of(name))
    else:
        return None
    return (micros - _FIRST).cast("decimal(38,0)")


def packed_order(df: DataFrame, order: Sequence[str], code: Column | None = None) -> Column | None:
    """``order`` (one column, or a time and a whole number) as one number, with
    ``code`` (0 to 7) in its last three bits: of rows equal in ``order`` the one
    with the greatest code is greatest. Null where a column of ``order`` is
    null; None if the columns do not fit."""
    parts = [_whole(df, c) for c in order]
    if not 1 <= len(parts) <= 2 or any(p is None for p in parts):
        return None
    if len(parts) == 2 and not isinstance(df.schema[order[0]].dataType, _TIMES):
        return None
    value = parts[0]
    if len(parts) == 2:
        value = value * F.lit(Decimal(1 << 64)) + parts[1].cast("decimal(20,0)")
    if code is not None:
        value = value.cast("decimal(37,0)") * CODES + code.cast("decimal(1,0)")
    return value.cast("decimal(38,0)")


def code_of(packed: Column) -> Column:
    """The code in a packed order."""
    return (packed % CODES).cast("int")


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], count: str | None = None) -> DataFrame:
    """One whole row per distinct ``keys``: the one with the greatest ``order``,
    of equal ones the greatest by its other columns. ``count`` adds the number
    of rows of the key.

    Rows without a value in ``order`` come before all others; null keys are keys
    like any other. The join compares keys only (the order is a filter on top),
    so the winners stay where their aggregation put them, and a key with many
    rows is split by adaptive skew handling.
    """
    taken = {c.lower() for c in rows.columns}
    names = [f"_last_{i}" for i in range(len(keys))]
    if taken & {*names, "_last_value", "_last_count", "_last_place"}:
        raise ValueError("column names that begin with _last_ are taken")
    value = packed_order(rows, order)
    if value is None:
        value = F.struct(*map(col_of, order))  # other types: right, but a sort aggregate
    best = rows.groupBy(*(col_of(k).alias(n) for k, n in zip(keys, names))) \
        .agg(F.max(value).alias("_last_value"), F.count(F.lit(1)).alias("_last_count"))
    same = F.coalesce(value >= F.col("_last_value"), value.isNull() & F.col("_last_value").isNull())
    for k, n in zip(keys, names):
        same = same & col_of(k).eqNullSafe(F.col(n))
    rest = [col_of(c).desc() for c in rows.columns if c not in keys and not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
    place = F.row_number().over(Window.partitionBy(*map(col_of, keys)).orderBy(*(rest or [F.lit(1)])))
    out = rows.join(best, same).withColumn("_last_place", place).where("_last_place = 1")
    return out.select(*map(col_of, rows.columns), *([F.col("_last_count").alias(count)] if count else []))

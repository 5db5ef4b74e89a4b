"""Typing and cleaning (P1-P4): one projection, explicit null rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintner.functions.casting import to_float, to_int
from vintner.functions.names import clean_name, col_of, quote

# The label column of the training table, and the column and
# value the status stamp appends.
LABEL = "quality"
STATUS_COLUMN = "status"
STATUS_VALUE = "checked"


def clean_names(names: Iterable[str]) -> list[str]:
    """Cleaned names, raising if two inputs collide after cleaning (``a b`` and
    ``a_b``): Spark would accept the projection and fail only at write time."""
    out, seen = [], {}
    for n in names:
        c = clean_name(n)
        if c.lower() in seen:
            raise ValueError(f"columns {seen[c.lower()]!r} and {n!r} both clean to {c!r}")
        seen[c.lower()] = n
        out.append(c)
    return out


def cast_features(df: DataFrame, strict: bool = False) -> DataFrame:
    """Every column to float32 and spaces in names to underscores, in one
    ``select`` (a single Project, fused into the scan's codegen stage)."""
    names = clean_names(df.columns)
    text = _text_columns(df)
    return df.select(*[to_float(col_of(c), strict, c in text).alias(n)
                       for c, n in zip(df.columns, names)])


def cast_label(df: DataFrame, label: str = LABEL, strict: bool = False) -> DataFrame:
    """Replace the label by its integer cast (truncates: 5.7 -> 5). The
    label is found by the session's name rule; its column takes the name given."""
    found = label_column(df, label)
    if found is None:
        return df
    return df.select(*[to_int(col_of(c), strict).alias(label) if c == found else col_of(c) for c in df.columns])


def label_column(df: DataFrame, label: str = LABEL) -> str | None:
    """The column that ``label`` names (ignoring case unless the session is
    case-sensitive), or None."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return label if label in df.columns else None
    return next((c for c in df.columns if c.lower() == label.lower()), None)


def clean_table(df: DataFrame, label: str = LABEL, strict: bool = False) -> DataFrame:
    """P1 then P2: the typed training table."""
    return cast_label(cast_features(df, strict), label, strict)


def with_status(df: DataFrame, value: str = STATUS_VALUE) -> DataFrame:
    """Append ``status = 'checked'``. An existing ``status`` column (any
    case) is replaced in place."""
    return df.withColumn(STATUS_COLUMN, F.lit(value))


def drop_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Drop the label; a no-op when it is absent."""
    return df.drop(label)


def bad_value_counts(df: DataFrame) -> DataFrame:
    """Per column, how many non-null strings do not parse as a number.

    One aggregation pass (partial aggregation on every partition), then the one
    wide row is unpivoted to ``(column_name, bad_values)``.
    """
    names = clean_names(df.columns)
    text = _text_columns(df)
    wide = df.agg(*[
        F.count_if(col_of(c).isNotNull() & to_float(col_of(c), is_text=c in text).isNull()).alias(n)
        for c, n in zip(df.columns, names)
    ])
    return wide.unpivot([], [quote(n) for n in names], "column_name", "bad_values")


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

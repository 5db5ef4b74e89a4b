"""Row payloads and result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintner.functions.names import col_of


def row_values(columns: Sequence[str], dtype: str = "double") -> Column:
    """One row's feature values as an array, in the given column order."""
    return F.array(*[col_of(c).cast(dtype) for c in columns])


def json_record(**fields: Column) -> Column:
    """A flat JSON object from named columns, e.g. the per-job result
    record ``{"model_name": ..., "version": ...}``."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def split_request(columns: Sequence[str]) -> Column:
    """A one-row scoring request in pandas "split" orientation,
    ``{"columns": [...], "index": [0], "data": [[...]]}``. Built per row, so it
    needs no grouping and no shuffle."""
    return F.to_json(F.struct(
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.array(F.lit(0)).alias("index"),
        F.array(row_values(columns)).alias("data"),
    ))


def parse_predictions(c: Column) -> Column:
    """A scoring response such as ``[5.1, 6.0]`` as ``array<double>``;
    malformed text gives null instead of an error."""
    return F.from_json(c, "array<double>", {"mode": "PERMISSIVE"})


def model_uri(run_id: Column, artifact: str = "model", scheme: str = "runs:/") -> Column:
    """``runs:/<run_id>/model``."""
    return F.format_string(f"{scheme}%s/{artifact}", run_id)


def metric_line(name: str, value: Column, form: str = "%f") -> Column:
    """A report line such as ``  RMSE: 63.142800``, or with ``form='%s'``
    ``  RMSE: 63.1428``."""
    return F.format_string(f"  {name}: {form}", value)

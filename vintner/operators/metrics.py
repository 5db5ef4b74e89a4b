"""Regression metrics in one aggregation (A1-A4) and frame equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintner.functions.names import col_of


def metric_columns(label: str, prediction: str) -> list[Column]:
    """RMSE, MAE and R^2 as aggregate expressions.

    All of them cover the same rows: those with both a label and a
    prediction. R^2 follows the single-machine convention for a constant
    label: 1.0 when every residual is zero, else 0.0 (instead of a division
    by zero)."""
    y0, p0 = col_of(label).cast("double"), col_of(prediction).cast("double")
    y, p = F.when(p0.isNotNull(), y0), F.when(y0.isNotNull(), p0)
    res = F.sum(F.pow(y - p, 2))
    tot = F.var_pop(y) * F.count(y)
    r2 = (F.when(F.count(y) == 0, F.lit(None).cast("double"))
          .when(tot == 0, F.when(res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - res / tot))
    return [F.count(y).alias("n"),
            F.sqrt(F.avg(F.pow(y - p, 2))).alias("rmse"),
            F.avg(F.abs(y - p)).alias("mae"),
            r2.alias("r2")]


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction",
                       by: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """A4: all three metrics in one pass; ``by`` gives one row per group (the
    aggregate is partial on every task, so a hot group costs nothing extra)."""
    cols = metric_columns(label, prediction)
    out = df.groupBy(*[col_of(c) for c in by]).agg(*cols) if by else df.agg(*cols)
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if c in ("rmse", "mae", "r2") else col_of(c)
                           for c in out.columns])
    return out


def regression_metrics_by_sets(df: DataFrame, label: str, dimensions: Sequence[str],
                               prediction: str = "prediction", digits: int | None = None) -> DataFrame:
    """A4 for several segmentations in one pass: ``GROUPING SETS`` expands each
    row once per dimension inside the same aggregation (one scan, one shuffle).
    Output: ``dimension, segment, n, rmse, mae, r2``."""
    dims = list(dimensions)
    out = df.groupingSets([[col_of(d)] for d in dims], *[col_of(d) for d in dims]).agg(
        F.grouping_id().alias("_gid"), *metric_columns(label, prediction))
    # grouping_id sets bit (len-1-i) when dimension i is NOT grouped
    n = len(dims)
    dim = F.lit(None).cast("string")
    seg = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        only_i = F.col("_gid") == F.lit(((1 << n) - 1) ^ (1 << (n - 1 - i)))
        dim = F.when(only_i, F.lit(d)).otherwise(dim)
        seg = F.when(only_i, col_of(d).cast("string")).otherwise(seg)
    cols = [dim.alias("dimension"), seg.alias("segment"), F.col("n")]
    for m in ("rmse", "mae", "r2"):
        cols.append(F.round(m, digits).alias(m) if digits is not None else F.col(m))
    return out.select(*cols)


_BUCKETS = 4096


def _fingerprint(rows: DataFrame, cols: list[Column], prefix: str) -> DataFrame:
    """(bucket, sums of two row hashes, rows) for every bucket of row hashes:
    sums do not depend on the order of rows, and copies count."""
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    return rows.groupBy(F.pmod(one, F.lit(_BUCKETS)).alias(f"{prefix}_bucket")).agg(
        F.sum(one.cast("decimal(20,0)")).alias(f"{prefix}_one"),
        F.sum(two.cast("decimal(20,0)")).alias(f"{prefix}_two"), F.count(F.lit(1)).alias(f"{prefix}_n"))


def frame_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only in ``left`` and only in ``right`` (with multiplicity), as
    one row ``(only_left, only_right)``.

    Each frame is summed up in 4,096 buckets of its row hashes (two 64-bit
    hashes and a count per bucket; partial aggregation, so a task sends at most
    4,096 small rows). Buckets that agree hold the same rows; equal frames are
    thus compared without shuffling a row. Rows of the other buckets are tagged,
    unioned and grouped by every column (grouping treats nulls as equal),
    counting copies per side: a row repeated a billion times costs a counter,
    not a billion generated rows in one task (as ``exceptAll`` would).
    """
    cols = [col_of(c) for c in left.columns]
    right = right.select(*cols)
    a, b = _fingerprint(left, cols, "_a"), _fingerprint(right, cols, "_b")
    same = F.lit(True)
    for part in ("one", "two", "n"):
        same = same & F.col(f"_a_{part}").eqNullSafe(F.col(f"_b_{part}"))
    differing = a.join(b, F.col("_a_bucket") == F.col("_b_bucket"), "full").where(~same) \
        .select(F.coalesce("_a_bucket", "_b_bucket").alias("_differs"))

    def side(rows: DataFrame, is_left: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*cols), F.lit(_BUCKETS))
        return rows.join(differing, bucket == F.col("_differs"), "left_semi") \
            .select(*cols, F.lit(is_left).alias("_l"), F.lit(1 - is_left).alias("_r"))

    per_row = side(left, 1).unionByName(side(right, 0)).groupBy(*cols).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    return per_row.agg(
        F.coalesce(F.sum(F.greatest(F.col("_nl") - F.col("_nr"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(F.col("_nr") - F.col("_nl"), F.lit(0))), F.lit(0)).alias("only_right"))


def frames_equal(left: DataFrame, right: DataFrame) -> bool:
    if sorted(left.columns) != sorted(right.columns):
        return False
    row = frame_difference(left, right).first()
    return row["only_left"] == 0 and row["only_right"] == 0

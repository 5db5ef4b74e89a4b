"""Scoring requests in batches (X7, batch form).

One split-orient request per chunk of ``rows_per_request`` rows, in key
order: ``{"columns": [...], "index": [positions], "data": [[...], ...]}``.
Positions come from the skew-safe sequence (no single-task global window);
each chunk is a bounded group, so ``collect_list`` never gathers more than
``rows_per_request`` rows in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintner.functions.names import col_of
from vintner.functions.payload import row_values
from vintner.operators.ranking import sequence_within_groups


def batch_requests(df: DataFrame, order: str, columns: Sequence[str],
                   rows_per_request: int = 100) -> DataFrame:
    """``(request_id, n_rows, request)``; ``order`` must be unique. ``df`` is
    read once for the positions and sampled once for their ranges (see
    ``ranking``): pass a written table, not a long lineage."""
    if rows_per_request < 1:
        raise ValueError("rows_per_request must be at least 1")
    cols = list(columns)
    numbered = sequence_within_groups(
        df.select(col_of(order).alias("_o"), row_values(cols).alias("_v")), [], "_o", "_pos")
    chunks = (numbered
              .groupBy(((F.col("_pos") - 1) / rows_per_request).cast("long").alias("request_id"))
              .agg(F.sort_array(F.collect_list(F.struct((F.col("_pos") - 1).alias("i"),
                                                        F.col("_v").alias("v")))).alias("_rows")))
    request = F.to_json(F.struct(
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        F.transform("_rows", lambda r: r["i"]).alias("index"),
        F.transform("_rows", lambda r: r["v"]).alias("data")))
    return chunks.select("request_id", F.size("_rows").alias("n_rows"), request.alias("request"))

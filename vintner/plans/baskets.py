"""Order baskets: the regression task built from ``lineitem``.

One row per order: ``k`` the order key, ``q`` total quantity, ``c`` number of
lines, ``d`` average discount, ``y`` total extended price in thousands. The
label has signal (``q`` and ``c`` both correlate with ``y``) and ``d`` has
none, so the L1 part of the penalty has a coefficient to zero out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintner.sources.tables import read_table

KEY = "k"
LABEL = "y"
ALL_FEATURES = ["q", "c", "d"]
SPLIT_FEATURES = ["q", "c"]


def cents(c: str):
    """A 2-decimal money column as a whole number of cents (``bigint``)."""
    return F.floor(F.col(c) * 100 + 0.5)


def basket_features(lineitem: DataFrame) -> DataFrame:
    """Group lines by order. Partial aggregation runs on every map task first,
    so an order with a huge number of lines is reduced before the shuffle.

    Money is summed as whole cents in a ``bigint``: the sum is exact whatever
    the order in which 1,000 executors add it up (reruns give identical
    doubles), it is a plain long sum for the hash aggregate, and it has no
    decimal range to overflow, with ANSI mode on or off.
    """
    n = F.count(F.lit(1)).cast("double")
    return (lineitem.groupBy(F.col("l_orderkey").alias(KEY))
            .agg(F.sum("l_quantity").alias("q"),
                 n.alias("c"),
                 (F.sum(cents("l_discount")).cast("double") / 100 / n).alias("d"),
                 (F.sum(cents("l_extendedprice")).cast("double") / 100000).alias(LABEL)))


def read_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_features(read_table(spark, sf_dir, "lineitem"))

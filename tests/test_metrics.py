import math

import pytest

from vintner.operators.metrics import frame_difference, frames_equal, regression_metrics


def test_metrics_values(spark):
    df = spark.createDataFrame([(3.0, 2.5), (5.0, 5.5), (7.0, 6.0)], "label double, prediction double")
    r = regression_metrics(df, "label").first()
    assert r.rmse == pytest.approx(math.sqrt((0.25 + 0.25 + 1) / 3))
    assert r.mae == pytest.approx((0.5 + 0.5 + 1) / 3)
    assert r.r2 == pytest.approx(1 - 1.5 / 8)


def test_r2_constant_label_rule(spark):
    same = spark.createDataFrame([(4.0, 4.0), (4.0, 4.0)], "label double, prediction double")
    off = spark.createDataFrame([(4.0, 4.0), (4.0, 5.0)], "label double, prediction double")
    assert regression_metrics(same, "label").first().r2 == 1.0
    assert regression_metrics(off, "label").first().r2 == 0.0


def test_one_row_and_segments(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 2.0, "b"), (4.0, 2.0, "b")],
                               "label double, prediction double, segment string")
    one = regression_metrics(df.limit(1), "label").first()
    assert one.n == 1 and one.rmse == 1.0
    seg = {r.segment: r for r in regression_metrics(df, "label", by=["segment"]).collect()}
    assert set(seg) == {"a", "b"} and seg["b"].mae == 1.0
    empty = regression_metrics(df.where("segment = 'zzz'"), "label").first()
    assert empty.n == 0 and empty.rmse is None


def test_frame_equality(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    r = frame_difference(a, b).first()
    assert (r.only_left, r.only_right) == (1, 1)
    assert frames_equal(a, a.select("v", "k")) and not frames_equal(a, b)


def test_frame_difference_nulls_and_hot_copies(spark):
    a = spark.createDataFrame([(None, "x")] * 5 + [(1, None)], "k int, v string")
    b = spark.createDataFrame([(None, "x")] * 2 + [(1, None), (2, "z")], "k int, v string")
    r = frame_difference(a, b).first()
    assert (r.only_left, r.only_right) == (3, 1)
    empty = frame_difference(a.limit(0), b.limit(0)).first()
    assert (empty.only_left, empty.only_right) == (0, 0)


def test_metrics_use_complete_pairs(spark):
    df = spark.createDataFrame([(3.0, 2.5), (5.0, None), (None, 1.0), (7.0, 6.0)],
                               "label double, prediction double")
    r = regression_metrics(df, "label").first()
    assert r.n == 2 and r.mae == pytest.approx(0.75)


def test_frame_difference_matches_plain_counts(spark):
    import collections
    import random
    r = random.Random(5)
    for n in (0, 1, 50, 3000):
        a = [(r.choice([None, 1, 2, 3]), r.choice(["x", None, "y"]), r.choice([0.5, float("nan"), None])) for _ in range(n)]
        b = list(a)
        r.shuffle(b)
        for _ in range(r.choice([0, 3])):
            b = b[1:] + [(9, "z", 1.5)]
        def count(rows):
            return collections.Counter(tuple("nan" if v != v else v for v in x) for x in rows)
        left, right = (spark.createDataFrame(x, "k int, t string, v double") for x in (a, b))
        got = frame_difference(left.repartition(5), right.select("v", "k", "t").repartition(3)).first()
        assert tuple(got) == ((count(a) - count(b)).total(), (count(b) - count(a)).total())


def test_equal_frames_shuffle_no_row(spark):
    """Only the fingerprints (a bucket, two sums, a count) and the rows of
    differing buckets pass an exchange; here no bucket differs."""
    from pyspark.sql import functions as F
    a = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.lit("a long text " * 5).alias("t"))
    per_row = frame_difference(a, a.select("t", "k").repartition(7))
    assert tuple(per_row.first()) == (0, 0)
    from test_plan_shapes import plan
    assert "LeftSemi" in plan(per_row)

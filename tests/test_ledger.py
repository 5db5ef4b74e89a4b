"""Partitioned ledgers: pruning, and days that are written again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_plan_shapes import plan
from vintner.operators.ledger import read_ledger, write_ledger
from vintner.operators.registry import runs_of_experiment
from vintner.operators.runs import updated_within


def records(spark, days, value):
    rows = [(f"e{i % 3}", f"r{i}", dt.datetime(2024, 1, d, i % 24), value) for d in days for i in range(60)]
    return spark.createDataFrame(rows, "experiment string, run_id string, ts timestamp, value double")


def test_rewriting_a_day_leaves_the_others(spark, tmp_dir):
    first = records(spark, [1, 2, 3], 1.0)
    path = write_ledger(first, tmp_dir + "/log")
    write_ledger(records(spark, [2], 5.0).limit(10), path, replace=True)
    got = {r.day.day: (r.n, r.s) for r in read_ledger(spark, path, first).groupBy("day").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got == {1: (60, 60.0), 2: (10, 50.0), 3: (60, 60.0)}
    write_ledger(records(spark, [2, 4], 2.0), path)  # appended
    assert read_ledger(spark, path).count() == 130 + 120
    assert read_ledger(spark, path, first).drop("day").schema.names == first.columns


def test_a_failed_rewrite_keeps_every_day(spark, tmp_dir):
    path = write_ledger(records(spark, [1, 2], 1.0), tmp_dir + "/log")
    bad = records(spark, [2], 2.0).withColumn("value", F.when(F.col("run_id") == "r7", F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken row"):
        write_ledger(bad, path, replace=True)
    assert read_ledger(spark, path).agg(F.sum("value")).first()[0] == 120.0


def test_predicates_open_only_their_folders(spark, tmp_dir):
    first = records(spark, range(1, 9), 1.0)
    log = read_ledger(spark, write_ledger(first, tmp_dir + "/log", by=["experiment"]), first)
    one = runs_of_experiment(log, "e1")
    assert one.count() == 160 and "PartitionFilters: [isnotnull(experiment" in plan(one)
    window = updated_within(log, dt.datetime(2024, 1, 4, 12))
    p = plan(window)
    assert "PartitionFilters" in p and "(day#" in p.split("PartitionFilters")[1].splitlines()[0]
    assert {r.day.day for r in window.collect()} == {3, 4, 5}
    plain = updated_within(log.drop("day"), dt.datetime(2024, 1, 4, 12))
    assert window.count() == plain.count()


def test_odd_times_and_names(spark, tmp_dir):
    df = spark.createDataFrame([("a/b", None, 1.0), (None, dt.datetime(2024, 1, 1), 2.0), ("x y", dt.datetime(2024, 1, 1), 3.0)],
                               "experiment string, ts timestamp, value double")
    log = read_ledger(spark, write_ledger(df, tmp_dir + "/odd", by=["experiment"]), df)
    assert sorted(map(str, log.drop("day").select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert runs_of_experiment(log, "a/b").count() == 1
    with pytest.raises(ValueError):
        write_ledger(df.withColumn("day", F.lit(1)), tmp_dir + "/odd")

"""The last row per key by a packed arg-max, against max over plain tuples."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_plan_shapes import plan
from vintner.operators import registry as reg
from vintner.operators.lastrow import code_of, last_rows, packed_order
from vintner.operators.runs import job_outcomes, outcome_counts, pipeline_outcomes

LOG = "run_id long, ts timestamp, seq long, life_cycle_state string, result_state string, state_message string"


def log_rows(n=2000, seed=2):
    r, rows = random.Random(seed), []
    for _ in range(n):
        run = r.choice([None, 1, 1, 1, *range(2, 60)])  # a null run and a hot one
        ts = r.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=r.randrange(5)), dt.datetime(1, 1, 2), dt.datetime(9999, 12, 30)])
        seq = r.choice([-(2**63), -1, 0, 1, 2**63 - 1, None])
        state = r.choice(["RUNNING", "TERMINATED", "INTERNAL_ERROR", None])
        rows.append((run, ts, seq, state, r.choice(["SUCCESS", "FAILED", "CANCELED", None]), r.choice(["m", None, "x" * 50])))
    return rows


def none_low(v):
    return (v is not None, v if v is not None else 0)


def key_of(row):
    order = row[1:3] if None not in row[1:3] else None
    return (order is not None, order or (), tuple((v is not None, v or "") for v in row[3:]), tuple(map(none_low, row[1:3])))


def test_last_rows_match_plain_maxima(spark):
    rows = log_rows()
    df = spark.createDataFrame(rows, LOG).repartition(5)
    got = {x.run_id: x for x in last_rows(df, ["run_id"], ["ts", "seq"], count="n").collect()}
    assert len(got) == len({r[0] for r in rows})
    for run, x in got.items():
        mine = [r for r in rows if r[0] == run]
        assert x.n == len(mine)
        known = [r for r in mine if None not in r[1:3]]
        assert tuple(x)[:-1] in mine
        if known:
            top = max(r[1:3] for r in known)
            assert (x.ts, x.seq) == top
            assert tuple(x)[3:6] == max((r[3:] for r in known if r[1:3] == top), key=lambda t: tuple((v is not None, v or "") for v in t))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_packed_order_is_the_order_of_the_columns(spark, kind):
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        times = ["0002-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-03-10 02:30:00", "2024-03-10 03:00:00", "2024-11-03 01:30:00.000001", "9998-12-31 23:59:59"]
        df = spark.createDataFrame([(t, s) for t in times for s in (-(2**63), -1, 7, 2**63 - 1)], "t string, s long").select(F.col("t").cast(kind), "s")
        for code in (None, F.lit(7)):
            out = df.withColumn("p", packed_order(df, ["t", "s"], code)).orderBy("t", "s", "p").collect()
            packed = [x.p for x in out]
            assert packed == sorted(packed) and len(set(packed)) == df.distinct().count()
        assert df.select(code_of(packed_order(df, ["t", "s"], F.lit(5))).alias("c")).distinct().collect()[0].c == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_other_order_types_still_work(spark):
    df = spark.createDataFrame([("a", "x", 1.5), ("a", "y", 0.5), ("b", None, 2.5)], "k string, o string, v double")
    assert packed_order(df, ["o"]) is None
    assert {tuple(x) for x in last_rows(df, ["k"], ["o"]).collect()} == {("a", "y", 0.5), ("b", None, 2.5)}
    assert {x.v for x in last_rows(df, ["k"], ["v"]).collect()} == {1.5, 2.5}
    assert last_rows(df.limit(0), ["k"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        last_rows(df.withColumn("_last_count", F.lit(1)), ["k"], ["v"])
    with pytest.raises(TypeError):
        outcome_counts(spark.createDataFrame([], LOG), tie_break="state_message")


def test_outcome_counts_agree_with_the_rows(spark):
    rows = [r for r in log_rows() if None not in r[1:3]]
    rows = list({r[:3]: r for r in rows}.values())  # one record per (run, time, place)
    log = spark.createDataFrame(rows, LOG)
    want = {(r.outcome, r.strict_outcome): r["count"] for r in job_outcomes(log, "seq").groupBy("outcome", "strict_outcome").count().collect()}
    assert {(r.outcome, r.strict_outcome): r.runs for r in outcome_counts(log, "seq").collect()} == want and len(want) >= 3


def test_no_sort_aggregate_in_last_states(spark):
    log = spark.createDataFrame(log_rows(50), LOG)
    acts = log.selectExpr("run_id", "life_cycle_state AS activity", "ts", "seq", "result_state AS status")
    registry = spark.createDataFrame([("m", 1, "Staging", "r", dt.datetime(2024, 1, 1))], "name string, version int, stage string, run_id string, ts timestamp")
    for df in (job_outcomes(log, "seq"), outcome_counts(log, "seq"), pipeline_outcomes(acts, "seq"), reg.latest_in_stage(registry, "Staging"),
               reg.latest_in_stage(registry, "Staging", "m"), reg.transition_stages(registry, registry.select("name", "version", "stage", "ts"))):
        p = plan(df)
        assert "SortAggregate" not in p and "HashAggregate" in p
    assert "state_message" not in plan(outcome_counts(log, "seq")).split("HashAggregate")[1]

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vintner.operators import registry as reg
from vintner.operators.ranking import sequence_within_groups
from vintner.operators.runs import job_outcomes, updated_within

TS = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(n, f"run-{i}", TS + dt.timedelta(minutes=i), i) for i, n in rows],
                                 "name string, run_id string, ts timestamp, seq long")


def test_register_versions_gap_free_and_continuing(spark):
    first = reg.register_models(None, requests(spark, [(1, "m"), (2, "m"), (3, "n")]), order="seq")
    assert sorted((r.name, r.version) for r in first.collect()) == [("m", 1), ("m", 2), ("n", 1)]
    second = reg.register_models(first, requests(spark, [(4, "m"), (5, "o"), (6, "m")]), order="seq")
    got = sorted((r.name, r.version, r.run_id) for r in second.collect())
    assert got == [("m", 1, "run-1"), ("m", 2, "run-2"), ("m", 3, "run-4"), ("m", 4, "run-6"),
                   ("n", 1, "run-3"), ("o", 1, "run-5")]


def test_sequence_on_hot_group_matches_row_number(spark):
    # one name holds most rows; few ranges force the offset path across ranges
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("name"),
        (F.col("id") * 7919 % 100003).alias("o"))
    ours = sequence_within_groups(df, ["name"], "o", "seq", partitions=16)
    from pyspark.sql import Window
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("name").orderBy("o")))
    bad = ours.join(ref, ["name", "o"]).where(F.col("seq") != F.col("ref")).count()
    assert ours.count() == 3000 and bad == 0


def registry(spark):
    return spark.createDataFrame(
        [("m", 1, "None", "r1", TS), ("m", 2, "None", "r2", TS), ("m", 3, "None", "r3", TS),
         ("n", 1, "None", "r4", TS)], "name string, version int, stage string, run_id string, ts timestamp")


def test_stage_transition_last_change_wins(spark):
    changes = spark.createDataFrame(
        [("m", 2, "Staging", TS), ("m", 2, "Production", TS + dt.timedelta(hours=1)),
         ("m", 3, "Staging", TS), ("x", 9, "Staging", TS)], "name string, version int, stage string, ts timestamp")
    out = {(r.name, r.version): r.stage for r in reg.transition_stages(registry(spark), changes).collect()}
    assert out == {("m", 1): "None", ("m", 2): "Production", ("m", 3): "Staging", ("n", 1): "None"}


def test_latest_in_stage_and_empty_stage(spark):
    r = registry(spark).withColumn("stage", F.when(F.col("version") <= 2, "Staging").otherwise("None"))
    assert reg.latest_version(r, "m", "Staging").version == 2
    with pytest.raises(LookupError):
        reg.latest_version(r, "unknown", "Staging")
    with pytest.raises(LookupError):
        reg.latest_version(r, "m", "Production")


def test_run_log_and_uri(spark):
    res = spark.createDataFrame([("r1", 1.0, 0.5, 0.9)], "run_id string, rmse double, mae double, r2 double")
    log = reg.log_runs(res, "exp", {"alpha": 0.75, "l1_ratio": 0.25}, ["rmse", "r2", "mae"], ts=F.lit(TS))
    got = {(r.kind, r.key): r.value for r in log.collect()}
    assert got == {("param", "alpha"): 0.75, ("param", "l1_ratio"): 0.25, ("metric", "rmse"): 1.0,
                   ("metric", "r2"): 0.9, ("metric", "mae"): 0.5}
    assert reg.runs_of_experiment(log, "other").count() == 0
    assert reg.with_model_uri(registry(spark)).first().model_uri == "runs:/r1/model"


LOG = "run_id long, ts timestamp, seq long, life_cycle_state string, result_state string, state_message string"


def test_job_outcomes_rules(spark):
    t = TS
    rows = [(1, t, 1, "RUNNING", None, None), (1, t + dt.timedelta(1), 2, "TERMINATED", "CANCELED", None),
            (2, t, 1, "PENDING", None, None),
            (3, t, 1, "TERMINATED", "FAILED", "boom"),
            (4, t, 1, "INTERNAL_ERROR", None, None),
            (5, t, 2, "TERMINATED", "SUCCESS", None), (5, t, 1, "RUNNING", None, None)]
    out = {r.run_id: (r.outcome, r.strict_outcome) for r in
           job_outcomes(spark.createDataFrame(rows, LOG), tie_break="seq").collect()}
    assert out == {1: ("succeeded", "failed"), 2: ("pending", "pending"), 3: ("failed", "failed"),
                   4: ("failed", "failed"), 5: ("succeeded", "succeeded")}


def test_window_bounds_inclusive(spark):
    now = dt.datetime(2024, 1, 15, 12)
    rows = [(1, now - dt.timedelta(days=1), 1, "RUNNING", None, None),
            (2, now + dt.timedelta(days=1), 1, "RUNNING", None, None),
            (3, now + dt.timedelta(days=1, microseconds=1), 1, "RUNNING", None, None)]
    got = {r.run_id for r in updated_within(spark.createDataFrame(rows, LOG), now).collect()}
    assert got == {1, 2}


def test_sequence_keeps_rows_of_any_order_type(spark):
    n = 400
    df = spark.range(n).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("name"), F.col("id").alias("v"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("nullable"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("ntz"),
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("tied"))
    for order in ("nullable", "ntz", "text", "tied"):
        for groups in (["name"], []):
            out = sequence_within_groups(df, groups, order, "seq", partitions=8).collect()
            assert len(out) == n
            for name in {r.name for r in out} if groups else {"all"}:
                rows = [r for r in out if not groups or r.name == name]
                assert sorted(r.seq for r in rows) == list(range(1, len(rows) + 1))
                placed = [r[order] for r in sorted(rows, key=lambda r: r.seq) if r[order] is not None]
                assert placed == sorted(placed)


def test_hot_and_cold_paths_with_base(spark):
    from pyspark.sql import Window
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit("hot"))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("name"),
        F.col("id").alias("o"))
    base = spark.createDataFrame([("hot", 10), ("g5", 3), (None, 100)], "name string, base int")
    ours = sequence_within_groups(df, ["name"], "o", "seq", base=base, partitions=8)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("name").orderBy("o")))
    ref = ref.join(base, ref["name"].eqNullSafe(base["name"]), "left").withColumn("ref", F.col("ref") + F.coalesce("base", F.lit(0)))
    joined = ours.join(ref, ours["o"] == ref["o"])
    assert ours.count() == 4000
    assert joined.where(ours["seq"] != ref["ref"]).count() == 0


def test_pipeline_outcomes_look_at_every_activity(spark):
    from vintner.operators.runs import pipeline_outcomes
    t = TS
    rows = [(1, "etl", t, 1, "Succeeded"), (1, "score", t, 2, "InProgress"),
            (1, "score", t + dt.timedelta(minutes=5), 3, "Failed"),
            (2, "etl", t, 1, "Succeeded"), (2, "score", t, 2, "InProgress"),
            (3, "etl", t, 1, "Succeeded"), (3, "score", t, 2, "Cancelled"), (3, "score", t, 1, "InProgress")]
    df = spark.createDataFrame(rows, "run_id long, activity string, ts timestamp, seq long, status string")
    out = {r.run_id: (r.outcome, r.activities) for r in pipeline_outcomes(df, tie_break="seq").collect()}
    assert out == {1: ("failed", 2), 2: ("pending", 2), 3: ("failed", 2)}


def test_sequence_with_dotted_group_name(spark):
    df = spark.range(600).select(
        F.when(F.col("id") < 400, F.lit("hot")).otherwise(F.lit("cold")).alias("g.name"),
        F.col("id").alias("o"))
    out = sequence_within_groups(df, ["g.name"], "o", "seq", partitions=4)
    got = {r[0]: r[1] for r in out.groupBy("`g.name`").agg(F.max("seq")).collect()}
    assert got == {"hot": 400, "cold": 200}


def test_stage_change_ties_and_null_names(spark):
    from vintner.operators.registry import transition_stages
    reg = spark.sql("SELECT * FROM VALUES (CAST(NULL AS string), 1, 'None', 'r', 0L), ('m', 1, 'None', 's', 0L) AS t(name, version, stage, run_id, ts)")
    changes = spark.sql("SELECT * FROM VALUES (CAST(NULL AS string), 1, 'Staging', 5L), ('m', 1, 'Production', 5L), ('m', 1, 'Staging', 5L) AS t(name, version, stage, ts)")
    out = {r["name"]: r["stage"] for r in transition_stages(reg, changes).collect()}
    assert out == {None: "Staging", "m": "Staging"}

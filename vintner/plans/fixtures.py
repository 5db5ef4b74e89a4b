"""Inputs of the registry, run-log and cleaning queries, derived by Spark from
the driver tables so that their work grows with the data.

* job-run log from ``events``: ``user_id`` is the run id, ``event_id`` breaks
  ties between records with the same ``ts``, ``event_type`` maps to states;
* model registrations from ``events``: one model per user, one version per event;
* raw CSV-like lines from ``lineitem``: every column a string, names with
  spaces, one text column that is not a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixture parameters (our choice): how event types map to job-run states. An error with value
# >= 25 is a terminated run with a FAILED result, a smaller one an internal error.
STATE_OF_EVENT = {
    "signup": ("PENDING", None),
    "view": ("RUNNING", None),
    "click": ("TERMINATED", "SUCCESS"),
    "purchase": ("TERMINATED", "CANCELED"),
}
ERROR_VALUE_FAILED = 25.0
STAGING_VALUE = 30.0
PRODUCTION_VALUE = 45.0
SECOND_BATCH_FROM = "2024-01-15 00:00:00"
WINDOW_NOW = "2024-01-15 12:00:00"
RUN_TS = "2024-01-31 00:00:00"


def job_log(events: DataFrame) -> DataFrame:
    et, v = F.col("event_type"), F.col("value")
    lcs = F.when(et == "error", F.when(v >= ERROR_VALUE_FAILED, F.lit("TERMINATED"))
                 .otherwise(F.lit("INTERNAL_ERROR")))
    res = F.when(et == "error", F.when(v >= ERROR_VALUE_FAILED, F.lit("FAILED")))
    for name, (state, result) in STATE_OF_EVENT.items():
        lcs = lcs.when(et == name, F.lit(state))
        res = res.when(et == name, F.lit(result))
    # when() chains evaluate in order; the error branch above is first
    return events.select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"),
                         lcs.alias("life_cycle_state"), res.alias("result_state"),
                         F.when(et == "error", F.col("props")).alias("state_message"))


def registration_requests(events: DataFrame) -> DataFrame:
    return (events.select(F.concat(F.lit("model-"), F.col("user_id").cast("string")).alias("name"),
                    F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("run_id"),
                    "ts", "event_id", "value"))


def stage_changes(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """A version whose run scored >= 30 goes to Staging, >= 45 then on to
    Production an hour later (the later change wins)."""
    scored = registry.join(requests.select("run_id", "value"), "run_id")
    staging = scored.where(F.col("value") >= STAGING_VALUE).select(
        "name", "version", F.lit("Staging").alias("stage"), "ts")
    prod = scored.where(F.col("value") >= PRODUCTION_VALUE).select(
        "name", "version", F.lit("Production").alias("stage"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return staging.unionByName(prod)


# Fixture parameters (our choice): an event's value gives its activity status.
ACTIVITY_IN_PROGRESS_BELOW = 10.0
ACTIVITY_FAILED_FROM = 150.0


def activity_log(events: DataFrame) -> DataFrame:
    """Pipeline activity runs: run = user, activity = event type."""
    v = F.col("value")
    status = (F.when(v < ACTIVITY_IN_PROGRESS_BELOW, F.lit("InProgress"))
              .when(v >= ACTIVITY_FAILED_FROM, F.lit("Failed")).otherwise(F.lit("Succeeded")))
    return events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("activity"),
                         "ts", F.col("event_id").alias("seq"), status.alias("status"))


RAW_LINE_COLUMNS = [  # (raw name, source column)
    ("order key", "l_orderkey"),
    ("quantity", "l_quantity"),
    ("extended price", "l_extendedprice"),
    ("discount", "l_discount"),
    ("tax", "l_tax"),
    ("return flag", "l_returnflag"),
    ("line number", "l_linenumber"),
]
RAW_LABEL = "line_number"


def raw_lines(lineitem: DataFrame) -> DataFrame:
    """``lineitem`` as a CSV reader would see it: strings, spaced names."""
    return lineitem.select(*[F.col(src).cast("string").alias(raw) for raw, src in RAW_LINE_COLUMNS])

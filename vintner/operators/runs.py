"""Job-run outcomes from a run-state log (J1) and a time-window predicate (F2).

Log rows: ``run_id, ts, life_cycle_state, result_state, state_message`` and an
optional tie-break column for records with the same ``ts``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintner.operators.ledger import DAY
from vintner.operators.lastrow import code_of, last_rows, packed_order

# Life-cycle states that end a run as failed, the terminal state,
# and the result state that marks a terminated run as failed.
FAILED_LIFE_CYCLE_STATES = ("INTERNAL_ERROR", "SKIPPED")
# Activity-run statuses of a pipeline run that are not errors,
# and the one that means still running.
ACTIVITY_OK_STATUSES = ("Succeeded", "InProgress")
ACTIVITY_RUNNING = "InProgress"
TERMINATED = "TERMINATED"
FAILED_RESULT = "FAILED"
SUCCESS_RESULT = "SUCCESS"


def outcome(life_cycle: Column, result: Column, strict: bool = False) -> Column:
    """``failed`` / ``succeeded`` / ``pending``. In the lenient rule only a
    ``FAILED`` result fails a terminated run (a cancelled or timed-out run
    counts as succeeded); ``strict`` requires ``SUCCESS``."""
    bad_result = (result != F.lit(SUCCESS_RESULT)) | result.isNull() if strict \
        else (result == F.lit(FAILED_RESULT))
    return (F.when(life_cycle.isin(*FAILED_LIFE_CYCLE_STATES), F.lit("failed"))
            .when((life_cycle == F.lit(TERMINATED)) & bad_result, F.lit("failed"))
            .when(life_cycle == F.lit(TERMINATED), F.lit("succeeded"))
            .otherwise(F.lit("pending")))


def job_outcomes(log: DataFrame, tie_break: str | None = None) -> DataFrame:
    """J1 over every run id: the last record by ``(ts, tie_break)`` decides, of
    equal ones the greatest by its texts. A hash aggregate finds the last
    record's order per run (:func:`vintner.operators.lastrow.last_rows`); states
    and message are fetched for that record only."""
    texts = ["life_cycle_state", "result_state", "state_message"]
    order = ["ts", tie_break] if tie_break else ["ts"]
    last = last_rows(log.select("run_id", *order, *texts), ["run_id"], order, count="records")
    lcs, res = F.col("life_cycle_state"), F.col("result_state")
    return last.select("run_id", F.col("ts").alias("last_ts"), *texts, "records",
                       outcome(lcs, res).alias("outcome"),
                       outcome(lcs, res, strict=True).alias("strict_outcome"))


def outcome_counts(log: DataFrame, tie_break: str | None = None) -> DataFrame:
    """J1 as a summary: ``outcome, strict_outcome, runs``. The outcome of a
    record is a small code packed behind its order, so one hash aggregate per
    run decides and no text leaves the scan. Of records equal in order the
    better outcome counts; a run without any time is pending."""
    names = ["pending", "failed", "succeeded"]
    lcs, res = F.col("life_cycle_state"), F.col("result_state")

    def code(strict: bool):
        value = outcome(lcs, res, strict)
        return F.when(value == names[1], F.lit(1)).when(value == names[2], F.lit(2)).otherwise(F.lit(0))

    both = F.when(code(False) == 0, F.lit(0)).otherwise(code(False) + 2 * code(True))  # 0, 3 .. 6
    packed = packed_order(log, ["ts", tie_break] if tie_break else ["ts"], both)
    if packed is None:
        raise TypeError(f"ts has to be a time and {tie_break!r} a whole number")
    of = code_of(F.col("_order"))
    lenient = F.when(of == 0, F.lit(names[0])).when(of % 2 == 1, F.lit(names[1])).otherwise(F.lit(names[2]))
    strict = F.when(of == 0, F.lit(names[0])).when(of < 5, F.lit(names[1])).otherwise(F.lit(names[2]))
    per_run = log.groupBy("run_id").agg(F.max(packed).alias("_order"))
    return per_run.groupBy(F.coalesce(lenient, F.lit(names[0])).alias("outcome"),
                           F.coalesce(strict, F.lit(names[0])).alias("strict_outcome")).agg(F.count(F.lit(1)).alias("runs"))


def updated_within(log: DataFrame, now: dt.datetime | str, before: dt.timedelta = dt.timedelta(days=1),
                   after: dt.timedelta = dt.timedelta(days=1), ts: str = "ts") -> DataFrame:
    """rows whose ``ts`` lies in ``[now - before, now + after]`` (bounds
    included). ``now`` is a parameter, so the query is repeatable; with a
    Parquet log the bounds are pushed into the scan, and of a ledger (a log with
    a ``day`` column, :mod:`vintner.operators.ledger`) only the days between
    them are opened."""
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    # bounds take the column's own type: wall-clock for TIMESTAMP_NTZ, the
    # session time zone for TIMESTAMP, never the Python process's zone
    dtype = log.schema[ts].dataType

    def bound(t: dt.datetime) -> Column:
        return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(dtype)
    inside = F.col(ts).between(bound(now - before), bound(now + after))
    if DAY in log.columns and ts != DAY:
        inside = inside & F.col(DAY).between(F.lit((now - before).date()), F.lit((now + after).date()))
    return log.where(inside)


def activity_class(status: Column) -> Column:
    """``pending`` while in progress, ``succeeded``, anything else ``failed``."""
    return (F.when(status == F.lit(ACTIVITY_RUNNING), F.lit("pending"))
            .when(status.isin(*ACTIVITY_OK_STATUSES), F.lit("succeeded"))
            .otherwise(F.lit("failed")))


def pipeline_outcomes(activities: DataFrame, tie_break: str | None = None) -> DataFrame:
    """J1 for pipeline runs: the last status of every activity of every run
    (not only the first activity), classified, then rolled up per run: failed
    if any activity failed, pending if any is still running, else succeeded.

    Input rows: ``run_id, activity, ts, status``. Both steps are hash
    aggregates: per (run, activity) the greatest order with the status class
    packed behind it (of equal orders a failure counts, then a success), and
    per run.
    """
    names = ["pending", "succeeded", "failed"]
    kind = activity_class(F.col("status"))
    code = F.when(kind == names[2], F.lit(2)).when(kind == names[1], F.lit(1)).otherwise(F.lit(0))
    packed = packed_order(activities, ["ts", tie_break] if tie_break else ["ts"], code)
    if packed is None:
        raise TypeError(f"ts has to be a time and {tie_break!r} a whole number")
    last = activities.groupBy("run_id", "activity").agg(F.max(packed).alias("_order")) \
        .withColumn("class", F.element_at(F.array(*map(F.lit, names)), F.coalesce(code_of(F.col("_order")), F.lit(0)) + 1))
    per_run = last.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("activities"),
        F.count_if(F.col("class") == "failed").alias("failed"),
        F.count_if(F.col("class") == "pending").alias("pending"))
    return per_run.withColumn(
        "outcome", F.when(F.col("failed") > 0, F.lit("failed"))
        .when(F.col("pending") > 0, F.lit("pending")).otherwise(F.lit("succeeded")))

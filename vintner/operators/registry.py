"""Model registry and run tracking as ordinary tables.

Registry rows: ``name, version, stage, run_id, ts``. Run log rows:
``experiment, run_id, kind ('param'|'metric'), key, value, ts``.
Writers replace tables with :func:`vintner.operators.publish.publish`
(staged overwrite); plain Parquet gives no concurrent version allocation, so a
registry table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintner.functions.names import col_of
from vintner.functions.payload import model_uri
from vintner.operators.lastrow import last_rows
from vintner.operators.ranking import sequence_within_groups

NO_STAGE = "None"
REGISTRY_COLUMNS = ["name", "version", "stage", "run_id", "ts"]


def register_models(registry: DataFrame | None, requests: DataFrame, order: str = "ts") -> DataFrame:
    """Append one version per request; versions continue per name after the
    registry's current maximum, in ``order`` (unique per name). Returns the
    whole new registry."""
    base = None
    if registry is not None:
        base = registry.groupBy("name").agg(F.max("version").alias("base"))
    numbered = sequence_within_groups(requests, ["name"], order, "version", base=base, dtype="int")
    new = numbered.select("name", "version", F.lit(NO_STAGE).alias("stage"), "run_id", "ts")
    return new if registry is None else registry.select(*REGISTRY_COLUMNS).unionByName(new)


def transition_stages(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """R2: set ``stage`` for the ``(name, version)`` pairs in ``changes``; the
    last change by ``ts`` wins, of equal ones the largest stage name. Other
    versions keep their stage (nothing is archived). ``(name, version)`` is
    unique, so the join has no hot key; a null name is a name like any other."""
    last = last_rows(changes.select("name", "version", "ts", "stage"), ["name", "version"], ["ts"]) \
        .select(F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("stage").alias("_new_stage"))
    same = F.col("name").eqNullSafe(F.col("_name")) & F.col("version").eqNullSafe(F.col("_version"))
    return (registry.join(last, same, "left")
            .select("name", "version", F.coalesce("_new_stage", "stage").alias("stage"),
                    "run_id", "ts"))


def latest_in_stage(registry: DataFrame, stage: str, name: str | None = None) -> DataFrame:
    """R3 + F1: per model name, the highest version in ``stage``. A hash
    aggregate finds the version; run id and time are fetched for it alone."""
    rows = registry.where(F.col("stage") == stage)
    if name is not None:
        rows = rows.where(F.col("name") == name)
    return last_rows(rows.select("name", "version", "run_id", "ts"), ["name"], ["version"]) \
        .select("name", "version", F.lit(stage).alias("stage"), "run_id", "ts")


def latest_version(registry: DataFrame, name: str, stage: str):
    """R3 for one model: the row, or a clear error when the stage is empty."""
    row = latest_in_stage(registry, stage, name).first()
    if row is None:
        raise LookupError(f"no version of model {name!r} in stage {stage!r}")
    return row


def log_runs(results: DataFrame, experiment: str | Column, params: Mapping[str, float],
             metrics: Sequence[str], run_id: str = "run_id", ts: Column | None = None) -> DataFrame:
    """R4 + R5: one tall row per parameter and metric of each run in
    ``results`` (a frame with a run id and metric columns)."""
    exp = F.lit(experiment) if isinstance(experiment, str) else experiment
    ts_col = ts if ts is not None else F.current_timestamp()
    wide = results.select(exp.alias("experiment"), col_of(run_id).cast("string").alias("run_id"),
                          ts_col.alias("ts"),
                          *[F.lit(float(v)).alias(k) for k, v in params.items()],
                          *[col_of(m).cast("double").alias(m) for m in metrics])
    keys = list(params) + list(metrics)
    tall = wide.unpivot(["experiment", "run_id", "ts"], keys, "key", "value")
    kind = F.when(F.col("key").isin(list(params)), F.lit("param")).otherwise(F.lit("metric"))
    return tall.select("experiment", "run_id", kind.alias("kind"), "key", "value", "ts")


def runs_of_experiment(run_log: DataFrame, experiment: str, kind: str | None = None) -> DataFrame:
    """The log rows of one experiment (a pushed-down equality predicate
    when the log is a Parquet table)."""
    rows = run_log.where(F.col("experiment") == experiment)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def with_model_uri(registry: DataFrame, artifact: str = "model") -> DataFrame:
    """``runs:/<run_id>/<artifact>`` for every registry row."""
    return registry.withColumn("model_uri", model_uri(F.col("run_id"), artifact))

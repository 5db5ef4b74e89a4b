"""The reference's two jobs as Spark applications.

``train_job``: land (if a landing path is given) -> read CSV as strings -> type -> publish the input table
-> exact split by content -> elastic-net fit on the cluster -> metrics on the test
part -> save the model -> append params and metrics to the run log -> register
a new version -> move it to a stage -> JSON result record.

``batch_score_job``: read CSV -> drop label -> type -> pick the model (by
registry stage, or an explicit path) -> prediction first -> publish to one or
several tables -> JSON result record.

Everything between the CSV and the published tables runs on executors; the
driver holds only the model's coefficients, one metrics row and one registry
row.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintner.functions.names import sanitize_identifier, strip_spaces
from vintner.operators import registry as reg
from vintner.operators.clean import LABEL, cast_features, clean_table, label_column, drop_label
from vintner.operators.fit import ALPHA, L1_RATIO, LinearModel, fit_elastic_net, load_model, save_model
from vintner.operators.metrics import regression_metrics
from vintner.operators.publish import append_table, exclusive, publish, publish_many, table_or_none
from vintner.operators.score import score
from vintner.operators.split import SPLIT_SEED, TEST_FRACTION, content_train_test
from vintner.session import scratch_scope
from vintner.sources.csv import read_csv_strings, read_sniffed_csv
from vintner.sources.landing import land_once

# Default database, input table and output table of the
# training and batch-scoring jobs, and the stage a new version moves to.
DEFAULT_DB = "wine"
INPUT_TABLE = "mlops_wine_quality_input"
OUTPUT_TABLE = "mlops_wine_quality_regression"
DEFAULT_STAGE = "staging"


@dataclass
class TrainParams:
    csv_path: str
    experiment: str
    model_name: str
    model_root: str                      # shared storage for model artifacts
    db: str = DEFAULT_DB
    table: str = INPUT_TABLE
    registry_table: str = "model_registry"
    runs_table: str = "runs"
    stage: str = DEFAULT_STAGE
    label: str = LABEL
    alpha: float = ALPHA
    l1_ratio: float = L1_RATIO
    test_fraction: float = TEST_FRACTION
    seed: int = SPLIT_SEED
    sniff: bool = False
    landing_path: str | None = None      # shared storage; lands the CSV there once
    now: dt.datetime | None = None


@dataclass
class ScoreParams:
    csv_path: str
    model_name: str | None = None
    model_path: str | None = None        # explicit model; else latest in ``stage``
    stage: str = DEFAULT_STAGE
    db: str = DEFAULT_DB
    tables: Sequence[str] = field(default_factory=lambda: [OUTPUT_TABLE])
    registry_table: str = "model_registry"
    label: str = LABEL
    sniff: bool = False


def _read(spark: SparkSession, path: str, sniff: bool) -> DataFrame:
    return read_sniffed_csv(spark, path) if sniff else read_csv_strings(spark, path)


def train_job(spark: SparkSession, p: TrainParams) -> dict:
    """The training job; its scratch tables are removed when it ends."""
    with scratch_scope(spark):
        return _train(spark, p)


def _train(spark: SparkSession, p: TrainParams) -> dict:
    db = sanitize_identifier(p.db)
    now = p.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    raw = _read(spark, p.csv_path, p.sniff)
    if p.landing_path:
        raw = read_csv_strings(spark, land_once(raw, p.landing_path))
    typed = publish(clean_table(raw, p.label), db, p.table)
    label = label_column(typed, p.label)
    if label is None:
        raise ValueError(f"the training table has no label column {p.label!r}")
    features = [c for c in typed.columns if c != label]
    # the published table has no key: its rows are split by their content, a
    # predicate that the fit and the metrics evaluate as they scan
    train, test = content_train_test(typed, p.test_fraction, p.seed)
    model = fit_elastic_net(train, features, p.label, p.alpha, p.l1_ratio)
    metrics = regression_metrics(score(test, model), p.label).first().asDict()

    run_id = uuid.uuid4().hex
    model_path = f"{p.model_root.rstrip('/')}/{run_id}/model"
    save_model(spark, model, model_path)
    run_row = spark.createDataFrame([(run_id, metrics["rmse"], metrics["mae"], metrics["r2"])],
                                    "run_id string, rmse double, mae double, r2 double")
    append_table(reg.log_runs(run_row, p.experiment, {"alpha": p.alpha, "l1_ratio": p.l1_ratio},
                              ["rmse", "r2", "mae"], ts=F.lit(now)), db, p.runs_table)

    version = register_version(spark, db, p.registry_table, p.model_name, run_id, p.stage, now)
    return {"model_name": p.model_name, "version": version, "run_id": run_id,
            "model_uri": model_path, "metrics": metrics}


def register_version(spark: SparkSession, db: str, registry_table: str, name: str, run_id: str, stage: str,
                     now: dt.datetime) -> int:
    """R1 + R2 as one step on the stored registry: the next version of ``name``,
    moved to ``stage``. Jobs that run side by side take turns, so versions are
    distinct and without gaps; a failing publish leaves the registry as it was."""
    with exclusive(spark, db, registry_table):
        current = table_or_none(spark, db, registry_table)
        request = spark.createDataFrame([(name, run_id, now)], "name string, run_id string, ts timestamp")
        registered = reg.register_models(current, request)
        version = registered.where(F.col("run_id") == run_id).select("version").first()["version"]
        change = spark.createDataFrame([(name, version, strip_spaces(stage), now)],
                                       "name string, version int, stage string, ts timestamp")
        publish(reg.transition_stages(registered, change), db, registry_table)
    return version


RUNS_SCHEME = "runs:/"


def uri_to_path(uri: str, model_root: str | None) -> str:
    """``runs:/<run_id>/<artifact>`` -> ``<model_root>/<run_id>/<artifact>``;
    any other string is taken as a path already."""
    if not uri.startswith(RUNS_SCHEME):
        return uri
    if model_root is None:
        raise ValueError("model_root is needed to resolve a runs:/ URI")
    return f"{model_root.rstrip('/')}/{uri[len(RUNS_SCHEME):].strip('/')}"


def resolve_model(spark: SparkSession, p: ScoreParams, model_root: str | None = None) -> tuple[LinearModel, str]:
    """S6 + R3 + R6: an explicit path or ``runs:/`` URI, or the latest version
    of ``model_name`` in ``stage`` read from the registry table."""
    if p.model_path:
        path = uri_to_path(p.model_path, model_root)
        return load_model(spark, path), path
    registry = spark.table(f"{sanitize_identifier(p.db)}.{p.registry_table}")
    row = reg.latest_version(registry, p.model_name, strip_spaces(p.stage))
    if model_root is None:
        raise ValueError("model_root is needed to resolve a model from the registry")
    path = f"{model_root.rstrip('/')}/{row['run_id']}/model"
    return load_model(spark, path), path


def batch_score_job(spark: SparkSession, p: ScoreParams, model_root: str | None = None) -> dict:
    if not p.tables:
        raise ValueError("no table to publish to")
    model, path = resolve_model(spark, p, model_root)
    with scratch_scope(spark):
        features = cast_features(drop_label(_read(spark, p.csv_path, p.sniff), p.label))
        publish_many(score(features, model), sanitize_identifier(p.db), list(p.tables))
    return {"model_name": p.model_name, "model_uri": path}


def result_json(record: dict, keys: Sequence[str]) -> str:
    """K8: the job's printed result record."""
    return json.dumps({k: record[k] for k in keys})

"""The end-to-end flow (C1) with its parameters (C2) as one Spark application:
read -> stamp -> split -> fit -> score -> publish, instead of separate jobs
that each re-read and re-score the input."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintner.operators.clean import with_status
from vintner.operators.fit import ALPHA, L1_RATIO, LinearModel, fit_elastic_net
from vintner.operators.metrics import regression_metrics
from vintner.operators.publish import publish, publish_copies
from vintner.operators.score import score
from vintner.operators.split import SPLIT_SEED, TEST_FRACTION, exact_split
from vintner.plans.baskets import KEY, LABEL, SPLIT_FEATURES, read_baskets
from vintner.plans.jobs import DEFAULT_DB, DEFAULT_STAGE, OUTPUT_TABLE
from vintner.session import materialize


@dataclass
class FlowParams:
    sf_dir: str
    db: str = DEFAULT_DB
    table: str = OUTPUT_TABLE
    location: str | None = None
    stage: str = DEFAULT_STAGE
    features: list[str] = field(default_factory=lambda: list(SPLIT_FEATURES))
    key: str = KEY
    label: str = LABEL
    alpha: float = ALPHA
    l1_ratio: float = L1_RATIO
    test_fraction: float = TEST_FRACTION
    seed: int = SPLIT_SEED
    extra_tables: list[str] = field(default_factory=list)   # fan-out targets (K5)


@dataclass
class FlowResult:
    predictions: DataFrame
    model: LinearModel
    metrics: dict
    copies: list[DataFrame] = field(default_factory=list)


def run_flow_full(spark: SparkSession, p: FlowParams) -> FlowResult:
    # L3: keep the typed, stamped frame (not the raw input) for the split
    # search, the fit, the evaluation and the scoring write. It is written to
    # the shared checkpoint folder rather than cached in executor memory, so
    # losing an executor costs a re-read of files, not a re-aggregation.
    typed = materialize(with_status(read_baskets(spark, p.sf_dir)), "flow-typed")
    flagged = exact_split(typed, p.key, p.test_fraction, p.seed)
    model = fit_elastic_net(flagged.where(~F.col("is_test")), p.features, p.label,
                            p.alpha, p.l1_ratio)
    row = regression_metrics(score(flagged.where(F.col("is_test")), model), p.label).first()
    published = publish(score(flagged.drop("is_test"), model), p.db, p.table,
                        location=p.location)
    # the fan-out copies read the published table: scoring runs once
    copies = publish_copies(published, p.db, p.extra_tables)
    return FlowResult(published, model, row.asDict() if row else {}, copies)


def run_flow(spark: SparkSession, p: FlowParams) -> DataFrame:
    """The published predictions table (prediction first, then inputs)."""
    return run_flow_full(spark, p).predictions

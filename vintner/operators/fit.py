"""Elastic-net linear regression on the cluster.

The objective is the one of the common single-machine elastic net:

    1/(2n) * ||y - Xw - b||^2 + alpha * r * ||w||_1 + alpha * (1 - r) / 2 * ||w||^2

on raw (unstandardised) features with a free intercept.

``fit_elastic_net`` computes the sufficient statistics (n, means and the
population covariance of features and label) in one pass, at any width: a task
turns its Arrow batches into one row (n, means, centred products), those rows
are merged on the cluster, and at most ``_MERGES`` rows reach the driver. The
p x p problem is then solved exactly by coordinate descent on the driver, as
Spark's own normal-equation solver does with its Gram matrix.

``fit_spark_ml`` gives the same model through ``pyspark.ml``'s
``LinearRegression`` with mapped parameters: Spark divides its L2 term by the
label's standard deviation s, so ``regParam = a*r + a*(1-r)*s`` and
``elasticNetParam = a*r / regParam`` with ``standardization=False``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintner.functions.names import col_of

# The hyper-parameters of the reference training job.
ALPHA = 0.75
L1_RATIO = 0.25

_MERGES = 256  # rows of merged moments that reach the driver, at most
_MAX_NORMAL_FEATURES = 4096  # Spark's limit for solver="normal"


@dataclass
class LinearModel:
    features: list[str]
    coefficients: list[float]
    intercept: float
    label: str = "label"
    alpha: float = ALPHA
    l1_ratio: float = L1_RATIO
    n_rows: int = 0
    extra: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "LinearModel":
        return LinearModel(**json.loads(text))


def assemble(df: DataFrame, features: Sequence[str], output: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Feature columns into one vector column, for ``pyspark.ml``. Null or
    NaN inputs raise by default; ``handle_invalid='skip'`` drops the rows."""
    names = [f"_vintner_f{i}" for i in range(len(features))]  # dotted names are no input columns
    wide = df.select("*", *[col_of(c).alias(n) for c, n in zip(features, names)])
    return VectorAssembler(inputCols=names, outputCol=output,
                           handleInvalid=handle_invalid).transform(wide).drop(*names)


def _joined(a, b):
    """Moments (n, means, centred products) of two row sets together."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


_MOMENTS = pa.schema([("part", pa.int64()), ("bad", pa.int64()), ("n", pa.int64()),
                      ("means", pa.binary()), ("products", pa.binary())])


def _moment_row(part: int, bad: int, moments) -> pa.RecordBatch:
    n, means, products = moments
    return pa.RecordBatch.from_pydict({"part": [part], "bad": [bad], "n": [n], "means": [means.tobytes()],
                                       "products": [products.tobytes()]}, schema=_MOMENTS)


def _merged(rows: list[dict], k: int):
    """(incomplete rows, moments) over rows of moments, in the order of their parts."""
    total = (0, np.zeros(k), np.zeros((k, k)))
    for r in sorted(rows, key=lambda r: r["part"]):
        total = _joined(total, (r["n"], np.frombuffer(r["means"]), np.frombuffer(r["products"]).reshape(k, k)))
    return sum(r["bad"] for r in rows), total


def moment_stats(df: DataFrame, features: Sequence[str], label: str,
                 on_null: str = "drop") -> dict:
    """n, means, covariance matrix, feature-label covariances, label variance
    and the number of incomplete rows, in one pass over the rows.

    A row with a null or NaN in any feature or the label is incomplete and left
    out, so all statistics cover the same complete rows. ``on_null='error'``
    raises if there is any such row.
    """
    if on_null not in ("drop", "error"):
        raise ValueError("on_null must be 'drop' or 'error'")
    cols = list(features) + [label]
    p = len(features)
    k = p + 1
    typed = df.select(*[col_of(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])

    def moments(batches):
        bad, total = 0, (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
            whole = ~np.isnan(x).any(axis=1)
            x, bad = x[whole], bad + int((~whole).sum())
            if len(x):
                means = x.mean(axis=0)
                x = x - means
                total = _joined(total, (len(x), means, x.T @ x))
        yield _moment_row(TaskContext.get().partitionId(), bad, total)

    def merge(table):
        rows = table.to_pylist()
        return pa.Table.from_batches([_moment_row(min(r["part"] for r in rows), *_merged(rows, k))])

    ddl = "part long, bad long, n long, means binary, products binary"
    merged = typed.mapInArrow(moments, ddl).groupBy(F.pmod("part", F.lit(_MERGES))).applyInArrow(merge, ddl)
    bad, (n, means, products) = _merged([r.asDict() for r in merged.collect()], k)
    if on_null == "error" and bad:
        raise ValueError(f"{bad} rows have null or NaN in {cols}")
    cov = products / max(n, 1)
    return {"n": n, "means": means[:p], "mean_y": means[p], "C": cov[:p, :p],
            "cy": cov[:p, p], "var_y": cov[p, p], "dropped": bad}


def _on_active_set(C: np.ndarray, cy: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The exact solution if the signs of ``w`` are its signs, else None."""
    on, out = w != 0, np.zeros(len(w))
    sign = np.sign(w[on])
    try:
        out[on] = np.linalg.solve(C[np.ix_(on, on)] + l2 * np.eye(int(on.sum())), cy[on] - l1 * sign)
    except np.linalg.LinAlgError:
        return None
    rest = np.abs(cy - C @ out)[~on]
    return out if (np.sign(out[on]) == sign).all() and (rest <= l1 * (1 + 1e-12)).all() else None


def solve_elastic_net(C: np.ndarray, cy: np.ndarray, alpha: float, l1_ratio: float,
                      max_sweeps: int = 100_000, tol: float = 1e-15) -> np.ndarray:
    """Coordinate descent on the covariance form of the objective (centred
    data, so the intercept drops out). Pure ridge / least squares is solved
    directly, and so is the problem on the active set as soon as that is known;
    a descent that settles in neither way raises."""
    p = len(cy)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    if p == 0:
        return np.zeros(0)
    if l1 == 0.0:
        return np.linalg.lstsq(C + l2 * np.eye(p), cy, rcond=None)[0]
    w = np.zeros(p)
    for sweep in range(1, max_sweeps + 1):
        change = 0.0
        for j in range(p):
            denom = C[j, j] + l2
            rho = cy[j] - C[j] @ w + C[j, j] * w[j]
            new = 0.0 if denom <= 0 else np.sign(rho) * max(abs(rho) - l1, 0.0) / denom
            change = max(change, abs(new - w[j]))
            w[j] = new
        if change <= tol * max(1.0, float(np.max(np.abs(w)))):
            return w
        if sweep % 100 == 0 and (exact := _on_active_set(C, cy, w, l1, l2)) is not None:
            return exact
    raise RuntimeError(f"coordinate descent did not settle in {max_sweeps} sweeps")


def fit_elastic_net(df: DataFrame, features: Sequence[str], label: str,
                    alpha: float = ALPHA, l1_ratio: float = L1_RATIO,
                    on_null: str = "drop") -> LinearModel:
    """A5: fit on the cluster; see the module docstring."""
    features = list(features)
    s = moment_stats(df, features, label, on_null)
    if s["n"] == 0:
        raise ValueError("no complete rows to fit")
    w = solve_elastic_net(s["C"], s["cy"], alpha, l1_ratio)
    b = float(s["mean_y"] - s["means"] @ w)
    return LinearModel(features, [float(x) for x in w], b, label, alpha, l1_ratio, s["n"],
                       {"dropped_rows": s["dropped"]})


def fit_spark_ml(df: DataFrame, features: Sequence[str], label: str,
                 alpha: float = ALPHA, l1_ratio: float = L1_RATIO, solver: str = "normal",
                 ) -> tuple[LinearRegressionModel, LinearModel]:
    """A5 through ``pyspark.ml.regression.LinearRegression`` with the mapped
    parameters. ``normal`` (one Gram-matrix pass, up to 4,096 features) uses the
    population standard deviation of the label, ``l-bfgs`` the sample one."""
    features = list(features)
    if solver == "normal" and len(features) > _MAX_NORMAL_FEATURES:
        raise ValueError(f"solver='normal' takes at most {_MAX_NORMAL_FEATURES} features; use 'l-bfgs'")
    names = [f"x{i}" for i in range(len(features))]
    data = assemble(df.select(*[col_of(c).cast("double").alias(n) for c, n in zip(features, names)],
                              col_of(label).cast("double").alias("label")).dropna(), names)
    sd = F.stddev_pop("label") if solver == "normal" else F.stddev_samp("label")
    sigma = data.agg(sd.alias("s")).first()["s"] or 0.0
    lam = alpha * l1_ratio + alpha * (1.0 - l1_ratio) * sigma
    lr = LinearRegression(featuresCol="features", labelCol="label", fitIntercept=True,
                          standardization=False, solver=solver, maxIter=1000, tol=1e-12,
                          regParam=lam, elasticNetParam=(alpha * l1_ratio / lam) if lam > 0 else 0.0)
    m = lr.fit(data)
    lm = LinearModel(features, [float(x) for x in m.coefficients], float(m.intercept), label,
                     alpha, l1_ratio, int(m.summary.numInstances) if m.hasSummary else 0)
    return m, lm


def coefficients_frame(spark: SparkSession, model: LinearModel, digits: int | None = None) -> DataFrame:
    """The fitted model as a small table ``(term, estimate)``; the intercept is
    the term ``(intercept)``."""
    rows = list(zip(model.features, model.coefficients)) + [("(intercept)", model.intercept)]
    if digits is not None:
        rows = [(t, round(v, digits) + 0.0) for t, v in rows]
    schema = T.StructType([T.StructField("term", T.StringType(), False),
                           T.StructField("estimate", T.DoubleType(), False)])
    return spark.createDataFrame(rows, schema)


def save_model(spark: SparkSession, model: LinearModel, path: str) -> str:
    """K9: persist a model as a one-row JSON table (readable by any engine)."""
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1) \
        .write.mode("overwrite").text(path)
    return path


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Load a model written by :func:`save_model`."""
    return LinearModel.from_json(spark.read.text(path).first()["value"])


def save_spark_ml(model: LinearRegressionModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_spark_ml(path: str) -> LinearRegressionModel:
    return LinearRegressionModel.load(path)

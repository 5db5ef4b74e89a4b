"""Scoring (U1, P5): a model applied to a table, prediction first.

For a linear model the prediction is a plain column expression
``b + sum(w_i * x_i)``: it stays inside whole-stage codegen, next to the scan,
with no Python worker. ``score_with_udf`` is the general path for any Python
predict function: an Arrow-batched pandas UDF, never a per-row UDF.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Iterator, Tuple

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintner.functions.names import col_of
from vintner.operators.fit import LinearModel, assemble

PREDICTION = "prediction"


def prediction_column(model: LinearModel) -> Column:
    """``intercept + sum(coefficient * feature)``, features bound by name.
    Every feature takes part, also at weight 0, so a null in any feature
    gives a null prediction; so does a NaN, as on the UDF path."""
    expr = F.lit(float(model.intercept))
    for name, w in zip(model.features, model.coefficients):
        expr = expr + F.lit(float(w)) * col_of(name).cast("double")
    return F.when(~F.isnan(expr), expr)


def score(df: DataFrame, model: LinearModel, output: str = PREDICTION) -> DataFrame:
    """P5: ``select(prediction, *)``: the prediction column first, then all inputs."""
    _check_features(df, model)
    return df.select(prediction_column(model).alias(output), "*")


def linear_predict_fn(model: LinearModel) -> Callable[[pd.DataFrame], pd.Series]:
    w = np.asarray(model.coefficients, dtype="float64")
    b = float(model.intercept)

    def predict(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(frame.to_numpy(dtype="float64") @ w + b)
    return predict


def score_with_udf(df: DataFrame, features: list[str],
                   predict: Callable[[pd.DataFrame], pd.Series],
                   output: str = PREDICTION) -> DataFrame:
    """U1, general form: ``predict`` receives a pandas frame of the feature
    columns (one Arrow batch at a time) and returns one value per row."""
    names = list(features)

    @F.pandas_udf("double")
    def _udf(*cols: pd.Series) -> pd.Series:
        frame = pd.concat([c.astype("float64") for c in cols], axis=1, keys=names)
        return predict(frame).astype("float64").reset_index(drop=True)

    return df.select(_udf(*[col_of(c) for c in names]).alias(output), "*")


_LOADED: dict = {}  # of a Python worker: the model that its tasks use


def score_with_model(df: DataFrame, features: list[str], uri: str,
                     loader: Callable[[dict[str, bytes]], Callable[[pd.DataFrame], pd.Series]],
                     output: str = PREDICTION, max_bytes: int = 256 << 20) -> DataFrame:
    """U1, any Python model by URI: ``loader`` gets the model's files (path below
    ``uri`` -> bytes) and returns a predict function; each Python worker calls it
    once. Spark reads the files, so any store that it reads will do; a model of
    more than ``max_bytes`` is refused, as its files go to every executor."""
    spark, names = df.sparkSession, list(features)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    size = files.agg(F.sum("length")).first()[0]
    if not size or size > max_bytes:
        raise ValueError(f"model at {uri}: {size or 0} bytes, expected 1 to {max_bytes}")
    leaf = "/" + uri.rstrip("/").rsplit("/", 1)[-1] + "/"
    held = spark.sparkContext.broadcast({r["path"].rsplit(leaf, 1)[-1] if leaf in r["path"] else r["path"].rsplit("/", 1)[-1]:
                                         bytes(r["content"]) for r in files.select("path", "content").collect()})
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def _udf(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        from vintner.operators.score import _LOADED as loaded
        if key not in loaded:
            loaded.clear()
            loaded[key] = loader(held.value)
        for cols in batches:
            cols = cols if isinstance(cols, tuple) else (cols,)  # one column comes bare
            frame = pd.concat([c.astype("float64") for c in cols], axis=1, keys=names)
            yield loaded[key](frame).astype("float64").reset_index(drop=True)

    return df.select(_udf(*[col_of(c) for c in names]).alias(output), "*")


def linear_loader(files: dict[str, bytes]) -> Callable[[pd.DataFrame], pd.Series]:
    """Loader of a model written by ``save_model``."""
    text = next(body for _, body in sorted(files.items()) if body.strip())
    return linear_predict_fn(LinearModel.from_json(text.decode()))


def score_spark_ml(df: DataFrame, model: LinearRegressionModel, features: list[str],
                   output: str = PREDICTION) -> DataFrame:
    """U1 with a ``pyspark.ml`` model: assemble, transform, prediction first."""
    tmp = "_vintner_features"
    out = model.copy().setFeaturesCol(tmp).setPredictionCol("_vintner_pred") \
        .transform(assemble(df, features, tmp))
    return out.select(F.col("_vintner_pred").alias(output), *[col_of(c) for c in df.columns])


_INPUTS = ("inputCol", "inputCols", "featuresCol", "itemsCol", "userCol", "itemCol")
_OUTPUTS = ("outputCol", "outputCols", "predictionCol", "probabilityCol", "rawPredictionCol", "varianceCol", "leafCol")


def _columns(stage, params: tuple[str, ...]) -> list[str]:
    """The columns that a stage's parameters of these names state."""
    out: list[str] = []
    for name in params:
        if stage.hasParam(name) and stage.isDefined(stage.getParam(name)):
            value = stage.getOrDefault(stage.getParam(name))
            out += [value] if isinstance(value, str) else list(value or [])
    return [c for c in out if c]


def load_stages(uri: str) -> list:
    """S6 for any saved ``pyspark.ml`` model or fitted pipeline: its stages in
    order, nested pipelines laid flat. The class comes from the metadata that is
    saved with the model, so the caller need not know it."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import DefaultParamsReader
    from pyspark.sql import SparkSession

    def flat(stage):
        return [x for s in stage.stages for x in flat(s)] if isinstance(stage, PipelineModel) else [stage]
    return flat(DefaultParamsReader.loadParamsInstance(uri, SparkSession.getActiveSession()))


def score_pipeline(df: DataFrame, uri: str, features: list[str] | None = None,
                   output: str = PREDICTION) -> DataFrame:
    """U1, any fitted ``pyspark.ml`` pipeline by URI: prediction first, then all
    input columns.

    Columns that the stages read must be in ``df`` or come from an earlier stage.
    A vector column that neither gives is built from ``features``, in that order;
    others missing raise and are named. What the stages add besides the
    prediction is dropped, and a column of ``df`` that is called like something
    a stage writes keeps its name and values.
    """
    stages = load_stages(uri)
    made: set[str] = set()
    needed: list[str] = []
    for stage in stages:
        needed += [c for c in _columns(stage, _INPUTS) if c not in made]
        made |= set(_columns(stage, _OUTPUTS))
    predicted = [c for s in stages for c in _columns(s, ("predictionCol",))]
    if not predicted:
        raise ValueError(f"no stage of {uri} predicts")
    # own columns keep out of the stages' way under other names
    own = [f"_vintner_in{i}" for i in range(len(df.columns))]
    data = df.select(*[col_of(c).alias(n) for c, n in zip(df.columns, own)])
    given = {c: n for c, n in zip(df.columns, own)}
    missing = [c for c in dict.fromkeys(needed) if c not in given]
    if missing:
        if features is None or len(missing) > 1:
            raise ValueError(f"input lacks columns {missing} of the model at {uri}")
        lacking = [f for f in features if f not in given]
        if lacking:
            raise ValueError(f"input lacks model features {lacking}")
        data = assemble(data, [given[f] for f in features], missing[0])
    data = data.withColumns({c: F.col(given[c]) for c in dict.fromkeys(needed) if c in given})
    for stage in stages:
        data = stage.transform(data)
    return data.select(F.col(predicted[-1]).alias(output), *[F.col(n).alias(c) for c, n in zip(df.columns, own)])


def _check_features(df: DataFrame, model: LinearModel) -> None:
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise ValueError(f"input lacks model features {missing}")

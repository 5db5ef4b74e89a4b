import numpy as np
import pytest
from pyspark.sql import functions as F

from vintner.operators.fit import (LinearModel, coefficients_frame, fit_elastic_net, fit_spark_ml,
                                   load_model, save_model, solve_elastic_net)
from vintner.operators.score import linear_predict_fn, score, score_spark_ml, score_with_udf


def synthetic(spark, n=2000, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.2] + [2.0, -1.0, 0.5]
    y = 1.5 + x @ [2.0, -0.7, 0.05] + rng.normal(scale=0.5, size=n)
    rows = [(int(i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double"), x, y


def numpy_cd(x, y, alpha, r, sweeps=20000):
    xc, yc = x - x.mean(0), y - y.mean()
    n = len(y)
    C, cy = xc.T @ xc / n, xc.T @ yc / n
    w = np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(len(w)):
            rho = cy[j] - C[j] @ w + C[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha * r, 0) / (C[j, j] + alpha * (1 - r))
    return w, y.mean() - x.mean(0) @ w


def test_fit_matches_coordinate_descent(spark):
    df, x, y = synthetic(spark)
    m = fit_elastic_net(df, ["a", "b", "c"], "y")
    w, b = numpy_cd(x, y, 0.75, 0.25)
    assert np.allclose(m.coefficients, w, rtol=1e-9, atol=1e-12)
    assert m.intercept == pytest.approx(b, rel=1e-9)
    assert m.coefficients[2] == 0.0  # the weak feature is cut by the L1 term


def test_one_feature_closed_form(spark):
    df, x, y = synthetic(spark)
    m = fit_elastic_net(df, ["a"], "y")
    cov = np.cov(x[:, 0], y, bias=True)[0, 1]
    w = np.sign(cov) * max(abs(cov) - 0.75 * 0.25, 0) / (x[:, 0].var() + 0.75 * 0.75)
    assert m.coefficients[0] == pytest.approx(w, rel=1e-10)


def test_spark_ml_mapping_agrees(spark):
    df, x, y = synthetic(spark)
    _, lm = fit_spark_ml(df, ["a", "b", "c"], "y")
    w, b = numpy_cd(x, y, 0.75, 0.25)
    assert np.allclose(lm.coefficients, w, rtol=1e-5, atol=1e-6)


def test_least_squares_and_constant_label(spark):
    df, x, y = synthetic(spark)
    ols = fit_elastic_net(df, ["a", "b"], "y", alpha=0.0)
    X = np.c_[np.ones(len(y)), x[:, :2]]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose([ols.intercept, *ols.coefficients], beta, rtol=1e-8)
    const = fit_elastic_net(df.withColumn("y", F.lit(3.0)), ["a", "b"], "y")
    assert const.coefficients == [0.0, 0.0] and const.intercept == pytest.approx(3.0)


def test_null_rows_dropped_or_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (None, 9.0), (3.0, 6.2)], "x double, y double")
    assert fit_elastic_net(df, ["x"], "y", alpha=0.0).n_rows == 3
    with pytest.raises(ValueError, match="null"):
        fit_elastic_net(df, ["x"], "y", on_null="error")


def test_score_paths_agree_and_prediction_first(spark):
    df, _, _ = synthetic(spark, n=500)
    m = fit_elastic_net(df, ["a", "b", "c"], "y")
    e = score(df, m)
    assert e.columns[0] == "prediction" and e.columns[1:] == df.columns
    u = score_with_udf(df, m.features, linear_predict_fn(m))
    ml_model, _ = fit_spark_ml(df, ["a", "b", "c"], "y")
    s = score_spark_ml(df, ml_model, ["a", "b", "c"])
    joined = (e.select("id", F.col("prediction").alias("e"))
              .join(u.select("id", F.col("prediction").alias("u")), "id")
              .join(s.select("id", F.col("prediction").alias("s")), "id"))
    r = joined.agg(F.max(F.abs(F.col("e") - F.col("u"))).alias("eu"),
                   F.max(F.abs(F.col("e") - F.col("s"))).alias("es")).first()
    assert r.eu < 1e-9 and r.es < 1e-4


def test_score_binds_by_name(spark):
    m = LinearModel(["b", "a"], [10.0, 1.0], 0.5)
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert score(df, m).first().prediction == pytest.approx(0.5 + 20.0 + 1.0)
    with pytest.raises(ValueError, match="lacks"):
        score(df.drop("b"), m)


def test_model_save_load_and_table(spark, tmp_dir):
    m = LinearModel(["a"], [2.0], 1.0, "y")
    again = load_model(spark, save_model(spark, m, tmp_dir + "/m"))
    assert again == m
    rows = {r.term: r.estimate for r in coefficients_frame(spark, m).collect()}
    assert rows == {"a": 2.0, "(intercept)": 1.0}


def test_solver_zero_variance_feature():
    w = solve_elastic_net(np.array([[0.0]]), np.array([0.0]), 0.75, 1.0)
    assert w.tolist() == [0.0]


def test_dropped_rows_reported(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, float("nan")), (None, 9.0), (3.0, 6.0)], "x double, y double")
    m = fit_elastic_net(df, ["x"], "y", alpha=0.0)
    assert m.n_rows == 2 and m.extra["dropped_rows"] == 2
    assert m.coefficients[0] == pytest.approx(2.0)


def test_null_feature_gives_null_on_both_paths(spark):
    m = LinearModel(["a", "b"], [2.0, 0.0], 1.0)
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    e = [r.prediction for r in score(df, m).orderBy("a").collect()]
    u = [r.prediction for r in score_with_udf(df, m.features, linear_predict_fn(m)).orderBy("a").collect()]
    assert e == [None, 5.0] and u == [None, 5.0]


def test_spark_ml_lbfgs_mapping(spark):
    df, x, y = synthetic(spark)
    _, lm = fit_spark_ml(df, ["a", "b", "c"], "y", solver="l-bfgs")
    w, b = numpy_cd(x, y, 0.75, 0.25)
    assert np.allclose(lm.coefficients, w, rtol=1e-3, atol=1e-3)


def test_nulls_are_refused_at_every_width(spark):
    import numpy as np
    import pytest
    from pyspark.sql import functions as F
    from vintner.operators.fit import fit_elastic_net
    rng = np.random.default_rng(3)
    for width in (3, 65, 200):
        names = [f"f.{i}" for i in range(width)]
        x = rng.normal(size=(300, width))
        rows = [[float(v) for v in r] + [float(r[0] * 3 + 1)] for r in x]
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in [*names, "y"]))
        full = fit_elastic_net(df, names, "y", alpha=0.01, on_null="error")
        assert full.n_rows == 300 and abs(full.coefficients[0] - 3) < 0.1
        holes = df.withColumn("y", F.when(F.col("`f.1`") < 0, F.col("y")))
        bad = int((x[:, 1] >= 0).sum())
        with pytest.raises(ValueError, match=f"{bad} rows"):
            fit_elastic_net(holes, names, "y", on_null="error")
        part = fit_elastic_net(holes, names, "y")
        assert part.n_rows == 300 - bad and part.extra["dropped_rows"] == bad


def test_spark_ml_takes_dotted_names(spark):
    from vintner.operators.fit import assemble, fit_elastic_net, fit_spark_ml
    df = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i) for i in range(60)], "`a.b` double, c double, y double")
    exact, by_ml = fit_elastic_net(df, ["a.b", "c"], "y"), fit_spark_ml(df, ["a.b", "c"], "y")[1]
    assert max(abs(a - b) for a, b in zip(exact.coefficients, by_ml.coefficients)) < 1e-5
    assert assemble(df, ["a.b", "c"]).columns == ["a.b", "c", "y", "features"]


def test_moments_of_shifted_columns_and_empty_frames(spark):
    import numpy as np
    from vintner.operators.fit import moment_stats
    x = np.random.default_rng(5).normal(size=(500, 2)) + 1e7
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, y double").repartition(7)
    s = moment_stats(df, ["a"], "y")
    assert abs(s["C"][0, 0] - x[:, 0].var()) < 1e-6 and abs(s["var_y"] - x[:, 1].var()) < 1e-6
    assert moment_stats(df.limit(0), ["a"], "y")["n"] == 0


def test_near_collinear_columns_are_solved_exactly():
    import numpy as np
    from vintner.operators.fit import solve_elastic_net
    rng = np.random.default_rng(7)
    a = rng.normal(size=1000)
    x = np.stack([a, a + 1e-6 * rng.normal(size=1000)], axis=1)
    C, cy = np.cov(x.T, bias=True), np.array([1.0, 1.0 - 1e-9])
    w = solve_elastic_net(C, cy, 0.01, 0.5)
    slack = cy - C @ w - 0.005 * w
    assert all(abs(s - 0.005 * np.sign(v)) < 1e-8 if v else abs(s) <= 0.005 + 1e-8 for s, v in zip(slack, w))


def test_model_by_uri_and_missing_features(spark, tmp_dir):
    from vintner.operators.fit import LinearModel, save_model
    from vintner.operators.score import linear_loader, score, score_with_model
    model = LinearModel(["a"], [2.0], 1.0)
    uri = save_model(spark, model, tmp_dir + "/by-uri")
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "a double")
    by_uri = [r["prediction"] for r in score_with_model(df, ["a"], uri, linear_loader).collect()]
    assert by_uri == [r["prediction"] for r in score(df, model).collect()] == [3.0, None, None]


def test_active_sets_match_the_gram_route(spark):
    from vintner.operators.fit_active import fit_elastic_net_vector
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.5, 4, 12)
    y = x[:, 0] * 2 - x[:, 3] + 0.2 * x[:, 7] + 5 + rng.normal(size=600)
    x[5, 2] = np.nan
    names = [f"f{i}" for i in range(12)]
    wide = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], [*names, "y"])
    vectors = spark.createDataFrame([([float(v) for v in r], float(v)) for r, v in zip(x, y)] + [(None, 1.0), ([0.5] * 12, None)], "x array<double>, y double")
    a = fit_elastic_net(wide, names, "y", 0.3, 0.5)
    for grow in (1, 512):
        b = fit_elastic_net_vector(vectors.repartition(5), "x", "y", names, 0.3, 0.5, grow=grow)
        assert np.allclose(a.coefficients, b.coefficients, atol=1e-8) and abs(a.intercept - b.intercept) < 1e-8
        assert b.n_rows == 599 and b.extra["dropped_rows"] == 3 and b.extra["active"] < 12
    with pytest.raises(ValueError):
        fit_elastic_net_vector(vectors, "x", "y", names, 0.3, 0.0)
    with pytest.raises(Exception, match="features, expected 13"):
        fit_elastic_net_vector(vectors, "x", "y", [*names, "more"])
    with pytest.raises(ValueError, match="no complete rows"):
        fit_elastic_net_vector(vectors.limit(0), "x", "y", names)


def test_twenty_thousand_features(spark):
    """No p x p matrix: 20,000 features would need 3.2 GB for one."""
    import resource
    from vintner.operators.fit_active import fit_elastic_net_vector
    p, n = 20_000, 400
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    base = spark.range(n, numPartitions=8)
    x = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: (F.pmod(F.xxhash64(F.col("id"), j), F.lit(2001)) - 1000) / 1000.0)
    rows = base.select(x.alias("x")).withColumn("y", 4 * F.col("x")[17] - 3 * F.col("x")[19_998] + 1)
    m = fit_elastic_net_vector(rows, "x", "y", [f"f{i}" for i in range(p)], 0.2, 0.9)
    on = [i for i, w in enumerate(m.coefficients) if w]
    assert {17, 19_998} <= set(on) and m.extra["active"] < 1000
    assert m.coefficients[17] > 2 and m.coefficients[19_998] < -1.5
    data = np.array(rows.select("x").collect(), dtype=float).reshape(n, p)
    y = np.array([r.y for r in rows.select("y").collect()])
    z = data - data.mean(axis=0)
    g = z.T @ ((y - y.mean()) - z @ np.array(m.coefficients)) / n
    w = np.array(m.coefficients)
    assert np.abs(g[w == 0]).max() <= 0.18 + 1e-6                           # the conditions of the optimum
    assert np.allclose(g[w != 0], 0.18 * np.sign(w[w != 0]) + 0.02 * w[w != 0], atol=1e-6)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB: less than 1 GB


def test_pipelines_are_scored_by_uri(spark, tmp_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
    from vintner.operators.score import score_pipeline
    df = spark.createDataFrame([(float(i), float(i % 7), "ab"[i % 2], 2.0 * i - i % 7, i % 2) for i in range(80)], "a double, `b.c` double, kind string, y double, flag int")
    ready = df.withColumnRenamed("b.c", "b")
    pipe = Pipeline(stages=[StringIndexer(inputCol="kind", outputCol="k"), VectorAssembler(inputCols=["a", "b", "k"], outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features"), LinearRegression(labelCol="y")])
    pipe.fit(ready).write().save(tmp_dir + "/pipe")
    clash = ready.withColumns({"prediction": F.lit("mine"), "raw": F.lit(1), "features": F.lit("text"), "x.y": F.lit(2)})
    out = score_pipeline(clash, tmp_dir + "/pipe", output="scored")
    assert out.columns == ["scored", *clash.columns]
    assert all(abs(r.scored - r.y) < 1e-6 and r.prediction == "mine" and r.raw == 1 and r.features == "text" for r in out.collect())
    # bare models and nested pipelines; the vector comes from named columns
    tree = DecisionTreeRegressor(labelCol="y").fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(ready))
    tree.write().save(tmp_dir + "/tree")
    assert score_pipeline(df, tmp_dir + "/tree", ["a", "b.c"]).count() == 80
    nested = Pipeline(stages=[Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="v")]), LogisticRegression(featuresCol="v", labelCol="flag")])
    nested.fit(ready).write().save(tmp_dir + "/nested")
    assert {r[0] for r in score_pipeline(ready.drop("flag"), tmp_dir + "/nested").select("prediction").distinct().collect()} <= {0.0, 1.0}
    with pytest.raises(ValueError, match="input lacks columns"):
        score_pipeline(ready.drop("kind"), tmp_dir + "/pipe")
    with pytest.raises(ValueError, match="input lacks model features"):
        score_pipeline(ready, tmp_dir + "/tree", ["a", "missing"])

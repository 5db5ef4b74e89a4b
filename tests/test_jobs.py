import numpy as np
import pytest

from vintner.operators.fit import load_model
from vintner.operators.split import exact_split, with_row_key
from vintner.plans.jobs import ScoreParams, TrainParams, batch_score_job, result_json, train_job

# Column names of the public wine-quality CSV (header row).
WINE_COLUMNS = ["fixed acidity", "volatile acidity", "citric acid", "residual sugar", "chlorides",
                "free sulfur dioxide", "total sulfur dioxide", "density", "pH", "sulphates",
                "alcohol", "quality"]


def write_wine_csv(path, n=300, seed=3, sep=","):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.5, 2.0, size=(n, 11)).round(2)
    q = np.clip((3 + x[:, 10] * 2 + x[:, 0] - x[:, 1] + rng.normal(0, 0.3, n)).round(), 3, 9)
    lines = [sep.join(f'"{c}"' if sep == ";" else c for c in WINE_COLUMNS)]
    for i in range(n):
        lines.append(sep.join([*(f"{v:.2f}" for v in x[i]), str(int(q[i]))]))
    lines += lines[1:21]  # exact copies
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_row_key_unique_with_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")] * 3 + [(3, "c")], "x int, y string")
    keyed = with_row_key(df, "rk")
    assert keyed.select("rk").distinct().count() == 54
    a = sorted(tuple(r) for r in exact_split(keyed, "rk").where("is_test").select("x", "y").collect())
    b = sorted(tuple(r) for r in exact_split(with_row_key(df.repartition(5), "rk"), "rk")
               .where("is_test").select("x", "y").collect())
    assert a == b and len(a) == 14


def test_train_then_score_by_stage(spark, tmp_dir):
    csv = write_wine_csv(tmp_dir + "/wine.csv")
    root = tmp_dir + "/models"
    tp = TrainParams(csv_path=csv, experiment="wine-exp", model_name="wine-model", model_root=root,
                     db="ml@team.io")
    first = train_job(spark, tp)
    assert first["version"] == 1 and 0 < first["metrics"]["r2"] <= 1
    second = train_job(spark, tp)
    assert second["version"] == 2
    assert result_json(second, ["model_name", "version"]) == '{"model_name": "wine-model", "version": 2}'

    typed = spark.table("ml_team_io.mlops_wine_quality_input")
    assert typed.columns[-1] == "quality" and dict(typed.dtypes)["quality"] == "int"
    assert typed.count() == 320
    registry = {(r.version, r.stage) for r in spark.table("ml_team_io.model_registry").collect()}
    assert registry == {(1, "staging"), (2, "staging")}
    runs = spark.table("ml_team_io.runs")
    assert runs.count() == 10 and {r.key for r in runs.collect()} == {"alpha", "l1_ratio", "rmse", "r2", "mae"}

    sp = ScoreParams(csv_path=csv, model_name="wine-model", db="ml@team.io", tables=["scored_a", "scored_b"])
    out = batch_score_job(spark, sp, model_root=root)
    assert out["model_uri"].endswith(f"{second['run_id']}/model")
    scored = spark.table("ml_team_io.scored_b")
    assert scored.columns[0] == "prediction" and "quality" not in scored.columns
    assert len(scored.columns) == 12 and scored.count() == 320
    m = load_model(spark, out["model_uri"])
    row = scored.first()
    expect = m.intercept + sum(w * row[f] for f, w in zip(m.features, m.coefficients))
    assert row.prediction == pytest.approx(expect, rel=1e-6)


def test_semicolon_csv_is_sniffed(spark, tmp_dir):
    csv = write_wine_csv(tmp_dir + "/wine_semi.csv", n=40, sep=";")
    tp = TrainParams(csv_path=csv, experiment="e", model_name="semi", model_root=tmp_dir + "/m",
                     db="semi", sniff=True)
    assert train_job(spark, tp)["version"] == 1
    assert len(spark.table("semi.mlops_wine_quality_input").columns) == 12


def test_score_by_runs_uri(spark, tmp_dir):
    from vintner.plans.jobs import uri_to_path
    assert uri_to_path("runs:/abc/model", "/lake/models/") == "/lake/models/abc/model"
    assert uri_to_path("/x/model", None) == "/x/model"
    csv = write_wine_csv(tmp_dir + "/w.csv", n=60)
    root = tmp_dir + "/models"
    rec = train_job(spark, TrainParams(csv_path=csv, experiment="e", model_name="m", model_root=root,
                                       db="uri"))
    out = batch_score_job(spark, ScoreParams(csv_path=csv, model_path=f"runs:/{rec['run_id']}/model",
                                             db="uri", tables=["by_uri"]), model_root=root)
    assert out["model_uri"] == rec["model_uri"]
    assert spark.table("uri.by_uri").count() == 80


def test_flow_fans_out(spark, tmp_dir):
    from vintner.plans.flow import FlowParams, run_flow_full
    res = run_flow_full(spark, FlowParams(sf_dir="/root/testdata/sf0.001", db="flowdb", table="p0",
                                          extra_tables=["p1", "p2"]))
    n = res.predictions.count()
    assert [c.count() for c in res.copies] == [n, n]
    assert res.predictions.columns[0] == "prediction" and res.predictions.columns[-1] == "status"
    assert 0 < res.metrics["r2"] <= 1

import json

from pyspark.sql import functions as F

from vintner.functions.names import sanitize_identifier, strip_spaces
from vintner.functions.payload import json_record, parse_predictions, row_values, split_request
from vintner.operators.publish import publish, publish_many
from vintner.sources import land_once, read_csv_strings, read_sniffed_csv, sniff_delimiter


def write_text(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_strings_and_sniffing(spark, tmp_dir):
    p = write_text(tmp_dir + "/semi.csv", '"fixed acidity";"pH";"quality"\n7.4;"3,51";5\n7.8;3.2;6\n')
    assert sniff_delimiter(spark, p) == ";"
    df = read_sniffed_csv(spark, p)
    assert df.columns == ["fixed acidity", "pH", "quality"]
    assert all(t == "string" for _, t in df.dtypes)
    assert df.collect()[0]["pH"] == "3,51"
    single = write_text(tmp_dir + "/one.csv", "quality\n5\n6\n")
    assert sniff_delimiter(spark, single) == ","
    assert read_csv_strings(spark, single).count() == 2


def test_land_once_keeps_first_data(spark, tmp_dir):
    path = tmp_dir + "/landed"
    land_once(spark.range(5).selectExpr("CAST(id AS STRING) AS v"), path)
    land_once(spark.range(50).selectExpr("CAST(id AS STRING) AS v"), path)
    assert read_csv_strings(spark, path).count() == 5


def test_identifiers():
    assert sanitize_identifier("a@b.c") == "a_b_c"
    assert strip_spaces(" staging ") == "staging"


def test_publish_idempotent_and_self_overwrite(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    first = publish(df, "a@b.c", "t1").count()
    assert publish(df, "a@b.c", "t1").count() == first == 10
    assert spark.catalog.databaseExists("a_b_c")
    again = publish(spark.table("a_b_c.t1").withColumn("x", F.col("x") + 1), "a_b_c", "t1")
    assert again.agg(F.sum("x")).first()[0] == 90 + 10


def test_publish_many(spark):
    outs = publish_many(spark.range(4), "fan", ["t1", "t2", "t3"])
    assert [o.count() for o in outs] == [4, 4, 4]


def test_split_request_shape_and_parse(spark):
    df = spark.createDataFrame([(7.4, None)], "a double, b double")
    req = json.loads(df.select(split_request(["a", "b"])).first()[0])
    assert req == {"columns": ["a", "b"], "index": [0], "data": [[7.4, None]]}
    assert df.select(row_values(["a", "b"])).first()[0] == [7.4, None]
    resp = spark.createDataFrame([("[5.1, 6.0]",), ("not json",), ("[]",), (None,)], "t string")
    got = [r[0] for r in resp.select(parse_predictions(F.col("t"))).collect()]
    assert got == [[5.1, 6.0], None, [], None]


def test_json_record(spark):
    df = spark.createDataFrame([("wine-model", 3)], "name string, version int")
    rec = df.select(json_record(model_name=F.col("name"), version=F.col("version"))).first()[0]
    assert json.loads(rec) == {"model_name": "wine-model", "version": 3}


def test_sniff_tab_and_pipe(spark, tmp_dir):
    tab = write_text(tmp_dir + "/tab.csv", "a\tb\tc\n1\t2\t3\n4\t5\t6\n")
    pipe = write_text(tmp_dir + "/pipe.csv", "a|b\n1,5|2\n3|4\n")
    assert sniff_delimiter(spark, tab) == "\t"
    assert sniff_delimiter(spark, pipe) == "|"
    assert read_sniffed_csv(spark, tab).columns == ["a", "b", "c"]


def test_public_api_imports():
    import vintner
    assert all(hasattr(vintner, n) for n in vintner.__all__)


def test_batch_requests_chunks_in_key_order(spark):
    from vintner.operators.requests import batch_requests
    df = spark.createDataFrame([(k, float(k) / 2) for k in (5, 3, 9, 1, 7)], "k long, x double")
    rows = sorted(batch_requests(df, "k", ["x"], rows_per_request=2).collect())
    got = [(r.request_id, r.n_rows, json.loads(r.request)) for r in rows]
    assert got == [(0, 2, {"columns": ["x"], "index": [0, 1], "data": [[0.5], [1.5]]}),
                   (1, 2, {"columns": ["x"], "index": [2, 3], "data": [[2.5], [3.5]]}),
                   (2, 1, {"columns": ["x"], "index": [4], "data": [[4.5]]})]


def test_persisted_releases_cache(spark):
    from vintner.session import persisted
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    with persisted(df) as d:
        assert d.is_cached and d.count() == 100
    assert not df.is_cached


def test_publish_self_overwrite_at_location(spark, tmp_dir):
    loc = tmp_dir + "/ext_t"
    publish(spark.range(5).withColumn("x", F.lit(1)), "extdb", "t", location=loc)
    again = publish(spark.table("extdb.t").withColumn("x", F.col("x") + 1), "extdb", "t", location=loc)
    assert again.agg(F.sum("x")).first()[0] == 10
    assert not spark.catalog.tableExists("extdb.t__staging")


def test_land_parquet_and_sniff_empty(spark, tmp_dir):
    path = land_once(spark.range(3), tmp_dir + "/landed_pq", fmt="parquet")
    assert spark.read.parquet(path).count() == 3
    empty = write_text(tmp_dir + "/empty.csv", "")
    assert sniff_delimiter(spark, empty) == ","


def test_materialize_writes_under_checkpoint_dir(spark):
    from vintner.session import ensure_checkpoint_dir, materialize
    base = ensure_checkpoint_dir(spark).rstrip("/")
    out = materialize(spark.range(7), "probe")
    files = out.inputFiles()
    assert out.count() == 7 and files
    app = spark.sparkContext.applicationId
    assert all(f"/vintner/{app}/probe-" in f for f in files)
    def norm(u):
        return "/" + u.replace("file:", "").lstrip("/")
    assert all(norm(f).startswith(norm(base)) for f in files)


def test_crashed_landing_is_written_again(spark, tmp_dir):
    import os
    path = tmp_dir + "/crashed"
    os.makedirs(path + "/_temporary/0")
    land_once(spark.range(5).selectExpr("CAST(id AS STRING) AS v"), path)
    assert read_csv_strings(spark, path).count() == 5


def test_uneven_separators_raise(spark, tmp_dir):
    import pytest
    path = tmp_dir + "/uneven.csv"
    with open(path, "w") as f:
        f.write("a;b\n1;x;y\n")
    with pytest.raises(ValueError, match="separator"):
        sniff_delimiter(spark, path)


def test_texts_survive_landing(spark, tmp_dir):
    rows = [("1", 'say "hi", ok'), ("2", "two\nlines"), ("3", "back\\slash"), ("4", "plain")]
    path = land_once(spark.createDataFrame(rows, "k string, t string"), tmp_dir + "/texts")
    assert sorted(map(tuple, read_csv_strings(spark, path, multi_line=True).collect())) == rows

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T
from pyspark.testing import assertDataFrameEqual

from vintner.operators import clean

PEOPLE = T.StructType([T.StructField("first_name", T.StringType()),
                       T.StructField("last_name", T.StringType()),
                       T.StructField("email", T.StringType())])


def test_with_status_appends_checked_last(spark):
    df = spark.createDataFrame([("ann", "lee", "ann@example.org"), ("bo", "kim", None)], PEOPLE)
    out = clean.with_status(df)
    assert out.columns == ["first_name", "last_name", "email", "status"]
    assert not out.schema["status"].nullable
    expected = spark.createDataFrame(
        [("ann", "lee", "ann@example.org", "checked"), ("bo", "kim", None, "checked")],
        "first_name string, last_name string, email string, status string")
    assertDataFrameEqual(out, expected, checkRowOrder=False)


def test_with_status_zero_rows_and_existing_column(spark):
    assert clean.with_status(spark.createDataFrame([], PEOPLE)).count() == 0
    df = spark.createDataFrame([("a", "x", "b")], "first_name string, STATUS string, email string")
    out = clean.with_status(df)
    assert [c.lower() for c in out.columns] == ["first_name", "status", "email"]
    assert out.first()[1] == "checked"


def test_cast_features_null_rules(spark):
    raw = spark.createDataFrame(
        [("7.4", "", "5"), ("abc", "0.7", "5.7"), ("NaN", "1e-3", "-5.7"), (None, "3", None)],
        "`fixed acidity` string, `volatile acidity` string, quality string")
    out = clean.clean_table(raw)
    assert out.columns == ["fixed_acidity", "volatile_acidity", "quality"]
    assert [f.dataType for f in out.schema] == [T.FloatType(), T.FloatType(), T.IntegerType()]
    rows = [tuple(r) for r in out.collect()]
    assert rows[0][0] == pytest.approx(7.4) and rows[0][1] is None and rows[0][2] == 5
    assert rows[1][0] is None and rows[1][2] == 5          # text -> null, 5.7 -> 5
    assert rows[2][0] != rows[2][0] and rows[2][2] == -5   # NaN stays NaN, -5.7 -> -5
    assert rows[3] == (None, pytest.approx(3.0), None)


def test_cast_strict_raises(spark):
    raw = spark.createDataFrame([("abc",)], "x string")
    with pytest.raises(PySparkException):
        clean.cast_features(raw, strict=True).collect()


def test_name_clash_raises(spark):
    raw = spark.createDataFrame([("1", "2")], "`a b` string, a_b string")
    with pytest.raises(ValueError, match="both clean"):
        clean.cast_features(raw)


def test_dotted_name_is_quoted(spark):
    raw = spark.createDataFrame([("1.5",)], "`a.b` string")
    out = clean.cast_features(raw)
    assert out.columns == ["a.b"] and out.first()[0] == 1.5


def test_drop_label_noop_when_absent(spark):
    df = spark.createDataFrame([(1.0,)], "x float")
    assert clean.drop_label(df).columns == ["x"]
    assert clean.drop_label(df.selectExpr("x", "1 AS quality")).columns == ["x"]


def test_bad_value_counts(spark):
    raw = spark.createDataFrame([("1", "x"), ("", "2"), (None, "3")], "`a b` string, c string")
    got = {r["column_name"]: r["bad_values"] for r in clean.bad_value_counts(raw).collect()}
    assert got == {"a_b": 1, "c": 1}


def test_guarded_cast_equals_try_cast(spark):
    from pyspark.sql import functions as F
    from vintner.functions.casting import to_float
    texts = ["1", " 2.5 ", "-3e2", "1.5f", "0x1p3", "NaN", "nan", " -Infinity", "+inf", "INF\t",
             "infinity", "abc", "", " ", "1,5", "12abc", "--1", ".", "e5", "\x01inf", "Na N", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(to_float(F.col("t"), is_text=True).alias("g"), F.col("t").try_cast("float").alias("r"))
    for r in got.collect():
        assert (r.g == r.r) or (r.g is None and r.r is None) or (r.g != r.g and r.r != r.r)


def test_quoted_names_with_backticks_and_spaces(spark):
    from vintner.functions.names import col_of, quote
    assert quote("a`b") == "`a``b`"
    df = spark.createDataFrame([("1",)], "`we``ird name` string")
    assert df.select(col_of("we`ird name")).first()[0] == "1"
    out = clean.cast_features(df)
    assert out.columns == ["we`ird_name"] and out.first()[0] == 1.0


def test_label_is_found_by_the_session_name_rule(spark):
    from vintner.operators.clean import clean_table, label_column
    df = spark.createDataFrame([("1.5", "5.7")], "`a b` string, Quality string")
    out = clean_table(df, "quality")
    assert out.columns == ["a_b", "quality"] and out.first()["quality"] == 5
    assert label_column(df, "quality") == "Quality" and label_column(df, "other") is None

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from vintner.operators.split import exact_split, first_row, hash_split, split_threshold, train_test


def brute_test_keys(keys, fraction=0.25, seed=40):
    ordered = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))
    return set(ordered[:math.ceil(fraction * len(keys))])


@pytest.mark.parametrize("n,fraction", [(1, 0.25), (7, 0.25), (1000, 0.25), (999, 0.5), (50, 1.0)])
def test_exact_split_matches_brute_force(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.k for r in exact_split(df, "k", fraction).where("is_test").collect()}
    assert got == brute_test_keys(range(n), fraction)


def test_refinement_levels_match_brute_force(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    thr = split_threshold(df, "k", exact_limit=1)  # forces several levels
    expected = max(brute_test_keys(range(5000)),
                   key=lambda k: (hashlib.md5(f"40:{k}".encode()).hexdigest(), k))
    assert thr[1] == expected


def test_split_is_disjoint_covering_and_partition_invariant(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    train, test = train_test(df, "k")
    assert train.count() + test.count() == 3000 and test.count() == 750
    assert train.join(test, "k").count() == 0
    again = exact_split(df.repartition(7), "k").where("is_test").select("k")
    assert again.exceptAll(test).count() == 0 and test.exceptAll(again).count() == 0


def test_empty_and_zero_fraction(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert exact_split(empty, "k").count() == 0
    df = spark.range(10).withColumnRenamed("id", "k")
    assert exact_split(df, "k", 0.0).where("is_test").count() == 0


def test_duplicate_key_detected(spark):
    df = spark.range(300).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="not unique"):
        split_threshold(df, "k", exact_limit=10)


def test_string_keys(spark):
    keys = [f"doc-{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k for r in exact_split(df, "k").where("is_test").collect()}
    assert got == brute_test_keys(keys)


def test_hash_split_rule(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    got = {r.k for r in hash_split(df, "k").where("is_test").collect()}
    exp = {k for k in range(2000) if hashlib.md5(f"40:{k}".encode()).hexdigest()[:4] < "4000"}
    assert got == exp


def test_first_row(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert first_row(df, "k").collect()[0].v == "a"


def test_null_key_and_bad_fraction_refused(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    with pytest.raises(ValueError, match="null"):
        exact_split(df, "k")
    with pytest.raises(ValueError, match="null"):
        exact_split(df, "k", 0.0)
    with pytest.raises(ValueError, match="test_fraction"):
        exact_split(df.dropna(), "k", 1.5)


def test_random_split_covers_input(spark):
    from vintner.operators.split import random_split
    df = spark.range(2000)
    train, test = random_split(df)
    assert train.count() + test.count() == 2000 and 350 < test.count() < 650
    assert train.join(test, "id").count() == 0


def test_hash_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    train, test = train_test(df, "k", exact=False)
    assert train.count() + test.count() == 3
    assert train.where("k IS NULL").count() == 1


def test_copies_across_the_threshold_raise_at_small_size(spark):
    import pytest
    df = spark.range(1000).selectExpr("id % 2 AS k")
    with pytest.raises(ValueError, match="not unique"):
        exact_split(df, "k")


def test_row_key_tells_microseconds_apart_in_any_zone(spark):
    from vintner.operators.split import with_row_key
    df = spark.sql("SELECT CAST(t AS timestamp_ntz) AS t, CAST(concat(t, 'Z') AS timestamp) AS z FROM VALUES "
                   "('2024-01-01 00:00:00.000001'), ('2024-01-01 00:00:00.000002') AS v(t)")
    zone, keys = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            keys.append(sorted(r["rk"] for r in with_row_key(df, "rk").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert keys[0] == keys[1] and len({k.split(":")[0] for k in keys[0]}) == 2


def content_brute(rows, fraction, seed, columns):
    import json
    key = lambda r: hashlib.md5(f"{seed}:".encode() + hashlib.sha256(json.dumps(
        {c: v for c, v in zip(columns, r) if v is not None}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest().encode()).hexdigest()
    ordered = sorted(rows, key=key)
    return sorted(map(repr, ordered[:math.ceil(fraction * len(rows))]))


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("kind", ["unique", "hot", "one", "null"])
def test_content_split_takes_the_promised_rows(spark, fraction, kind):
    from vintner.operators.split import content_split, content_train_test
    rows = {"unique": [(i, f"t{i}") for i in range(997)],
            "hot": [(1, "copy")] * 400 + [(2, "pair"), (2, "pair")] + [(i, "x") for i in range(10, 200)],
            "one": [(7, "same")] * 101, "null": [(None, None)] * 50 + [(1, None)] * 7 + [(None, "é")] * 3}[kind]
    df = spark.createDataFrame(rows, "a int, b string").withColumnRenamed("b", "b.c").repartition(6)
    out = content_split(df, fraction, 40).collect()
    assert sorted(repr(tuple(r)[:2]) for r in out) == sorted(map(repr, rows))
    assert sorted(repr(tuple(r)[:2]) for r in out if r.is_test) == content_brute(rows, fraction, 40, ["a", "b.c"])
    train, test = content_train_test(df, fraction, 40)
    assert (train.count(), test.count()) == (len(rows) - math.ceil(fraction * len(rows)), math.ceil(fraction * len(rows)))
    assert train.columns == df.columns


def test_content_split_levels_and_empty_table(spark):
    from vintner.operators.split import content_split, content_threshold
    df = spark.range(3000).select((F.col("id") % 700).alias("k"))
    assert content_threshold(df, exact_limit=1) == content_threshold(df)  # refines several levels
    assert content_split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        content_split(df, 1.5)


def test_content_split_does_not_shuffle_rows(spark):
    from test_plan_shapes import exchanges, plan
    from vintner.operators.split import content_split
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert exchanges(plan(content_split(rows.select("l_orderkey", "l_linenumber")))) == 0  # no copies: a predicate
    few = plan(content_split(rows.select("l_returnflag")))  # copies: only theirs, and counts per task
    assert "repartition" not in few.lower() and "rangepartitioning" not in few


def test_row_key_counts_plain_rows_without_sorting_them(spark):
    from vintner.operators.split import with_row_key
    rows = [(1, "a", 0.5)] * 9000 + [(1, "a", -0.0)] * 3 + [(1, "a", 0.0)] * 2 + [(None, None, None)] * 12 + [(i, "b", float("nan")) for i in range(50)]
    out = with_row_key(spark.createDataFrame(rows, "k long, `s.x` string, x double").repartition(7), "rk")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = out.collect()
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, rows))
    copies = {}
    for r in got:
        copies.setdefault(r["rk"].split(":")[0], []).append(int(r["rk"].split(":")[1]))
    assert sorted(map(len, copies.values())) == sorted([9000, 3, 2, 12] + [1] * 50)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())

"""Publishing replaces tables without ever losing rows."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vintner.operators import publish as pub
from vintner.operators.publish import create_database, drop_table, publish, publish_many, snapshots_of, table_or_none
from vintner.plans import jobs
from vintner.session import materialize, remove_folder, scratch_scope


def broken(spark, n=1000):
    """A frame that fails on one of its last rows."""
    return spark.range(n).withColumn("x", F.when(F.col("id") == n - 1, F.raise_error(F.lit("broken row"))).otherwise(F.lit(0)).cast("int"))


def local(path):
    return path.removeprefix("file:")


@pytest.mark.parametrize("own_place", [False, True])
@pytest.mark.parametrize("columns", ["id", "id, 1 AS x"])  # same columns as the broken frame, and others
def test_a_failed_publish_leaves_the_old_rows(spark, tmp_dir, own_place, columns):
    db, table = "keep_db", f"t_{own_place}_{len(columns)}"
    location = f"{tmp_dir}/it's here" if own_place else None
    publish(spark.range(1000).selectExpr(*columns.split(", ")), db, table, location=location)
    versions = snapshots_of(spark, db, table)
    with pytest.raises(Exception, match="broken row"):
        publish(broken(spark), db, table, location=location)
    assert spark.table(f"{db}.{table}").count() == 1000
    assert snapshots_of(spark, db, table) == versions
    base = os.path.dirname(local(versions[0]))
    assert [f for f in os.listdir(base) if f.startswith("snapshot-")] == [os.path.basename(versions[0])]


def test_a_first_publish_that_fails_leaves_no_table(spark):
    with pytest.raises(Exception, match="broken row"):
        publish(broken(spark), "keep_db", "never")
    assert table_or_none(spark, "keep_db", "never") is None
    assert publish(spark.range(3), "keep_db", "never").count() == 3


def test_readers_keep_their_version_and_older_ones_go(spark):
    seen = [publish(spark.range(n), "keep_db", "versions") for n in (1, 2, 3)]
    assert [f.count() for f in seen[1:]] == [2, 3]  # the frame of the second publish still reads its rows
    kept = snapshots_of(spark, "keep_db", "versions")
    base = os.path.dirname(local(kept[0]))
    assert len(kept) == 2 and sorted(os.listdir(base)) == sorted(os.path.basename(k) for k in kept)
    drop_table(spark, "keep_db", "versions")
    assert table_or_none(spark, "keep_db", "versions") is None and os.listdir(base) == []


def test_columns_and_format_may_change(spark):
    publish(spark.range(5), "keep_db", "shape")
    out = publish(spark.table("keep_db.shape").withColumn("x", F.col("id") * 2), "keep_db", "shape")
    assert out.columns == ["id", "x"] and out.agg(F.sum("x")).first()[0] == 20
    out = publish(out.select("x"), "keep_db", "shape", fmt="json")
    assert out.columns == ["x"] and spark.table("keep_db.shape").count() == 5
    assert not any(spark.catalog.tableExists(f"keep_db.shape{s}") for s in ("__next", "__before"))


def test_a_failed_rename_puts_the_old_table_back(spark, monkeypatch):
    publish(spark.range(5), "keep_db", "renamed")
    real = spark.sql

    def sql(text, *a, **k):
        if "__next` RENAME" in text:
            raise RuntimeError("catalog is gone")
        return real(text, *a, **k)
    monkeypatch.setattr(spark, "sql", sql)
    with pytest.raises(RuntimeError, match="catalog is gone"):
        publish(spark.range(9).withColumn("x", F.lit(1)), "keep_db", "renamed")
    monkeypatch.undo()
    assert spark.table("keep_db.renamed").columns == ["id"] and spark.table("keep_db.renamed").count() == 5
    assert publish(spark.range(9).withColumn("x", F.lit(1)), "keep_db", "renamed").count() == 9


def test_a_publish_killed_between_its_renames_heals(spark):
    publish(spark.range(5), "keep_db", "killed")
    spark.sql("ALTER TABLE keep_db.killed RENAME TO keep_db.killed__before")
    assert table_or_none(spark, "keep_db", "killed").count() == 5
    spark.sql("ALTER TABLE keep_db.killed RENAME TO keep_db.killed__before")
    assert publish(spark.range(6).withColumn("x", F.lit(1)), "keep_db", "killed").count() == 6
    assert not spark.catalog.tableExists("keep_db.killed__before")


def test_tables_not_published_here_are_replaced_too(spark):
    create_database(spark, "keep_db")
    spark.range(4).write.mode("overwrite").saveAsTable("keep_db.foreign_table")
    assert publish(spark.table("keep_db.foreign_table").selectExpr("id + 1 AS id"), "keep_db", "foreign_table").agg(F.sum("id")).first()[0] == 10
    spark.sql("CREATE OR REPLACE VIEW keep_db.a_view AS SELECT 1 AS id")
    with pytest.raises(ValueError, match="view"):
        publish(spark.range(4), "keep_db", "a_view")
    assert spark.table("keep_db.a_view").count() == 1


def test_fan_out_stops_without_loss(spark):
    publish_many(spark.range(7).withColumn("x", F.lit(0)), "keep_db", ["fan_a", "fan_b"])
    with pytest.raises(Exception, match="broken row"):
        publish_many(broken(spark), "keep_db", ["fan_a", "fan_b"])
    assert [spark.table(f"keep_db.{t}").count() for t in ("fan_a", "fan_b")] == [7, 7]


def test_a_failing_training_job_keeps_the_registry(spark, tmp_dir, monkeypatch):
    from test_jobs import write_wine_csv
    p = jobs.TrainParams(csv_path=write_wine_csv(tmp_dir + "/w.csv"), experiment="e", model_name="m", model_root=tmp_dir + "/models",
                         db="keep_jobs", now=dt.datetime(2024, 1, 1))
    assert jobs.train_job(spark, p)["version"] == 1

    def failing(registry, changes):
        return registry.withColumn("stage", F.raise_error(F.lit("broken row")).cast("string"))
    monkeypatch.setattr(jobs.reg, "transition_stages", failing)
    with pytest.raises(Exception, match="broken row"):
        jobs.train_job(spark, p)
    monkeypatch.undo()
    assert [(r.version, r.stage) for r in spark.table("keep_jobs.model_registry").collect()] == [(1, "staging")]
    assert jobs.train_job(spark, p)["version"] == 2


def test_scratch_scope_removes_what_was_written_inside(spark):
    kept = materialize(spark.range(3), "outside")
    with scratch_scope(spark) as paths:
        inside = materialize(spark.range(4), "inside")
        assert inside.count() == 4 and len(paths) == 1
        with pytest.raises(ValueError), scratch_scope(spark) as nested:
            materialize(spark.range(5), "nested")
            raise ValueError
    assert kept.count() == 3
    assert not any(os.path.exists(local(p)) for p in [*paths, *nested])
    remove_folder(spark, paths[0])  # already gone


def test_expired_folders_can_be_named_oddly(spark, tmp_dir):
    path = f"{tmp_dir}/it's a folder"
    spark.range(3).write.parquet(path)
    remove_folder(spark, path)
    assert not os.path.exists(path)
    assert pub.qualified("a b", "t`x") == "`a b`.`t``x`"


def test_writers_at_once_get_distinct_versions_without_gaps(spark):
    from concurrent.futures import ThreadPoolExecutor
    now = dt.datetime(2024, 1, 1)

    def register(i):
        return jobs.register_version(spark.newSession(), "keep_jobs", "many_writers", "m", f"run-{i}", "staging", now)
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(register, range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    stored = {r.run_id: r.version for r in spark.table("keep_jobs.many_writers").collect()}
    assert stored == {f"run-{i}": v for i, v in enumerate(versions)}
    assert not spark.catalog.tableExists("keep_jobs.many_writers__lock")


def test_locks_are_released_waited_for_and_broken(spark):
    with pytest.raises(ValueError), pub.exclusive(spark, "keep_db", "locked"):
        raise ValueError
    with pub.exclusive(spark, "keep_db", "locked"):
        with pytest.raises(TimeoutError), pub.exclusive(spark, "keep_db", "locked", wait=0.3):
            pass
    with pub.exclusive(spark, "keep_db", "locked", stale=-1):  # its owner is taken for dead
        with pub.exclusive(spark, "keep_db", "locked", wait=0.3):
            assert spark.catalog.tableExists("keep_db.locked__lock")
    assert not spark.catalog.tableExists("keep_db.locked__lock")

"""Publishing to catalog tables (K1-K6).

``publish`` = create the database if missing, then replace the table. A version
of a table is a folder of its own (a snapshot): the new rows are written beside
the old ones, and only when they are complete does one catalog statement point
the table at them. A write that fails, on whatever row, leaves the table as it
was; a reader sees all old or all new rows; a plan that reads the table it
replaces needs no staging copy. The version before the current one is kept for
readers that began earlier, older ones are removed.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vintner.functions.names import quote, sanitize_identifier
from vintner.session import remove_folder

_SNAPSHOTS = "vintner.snapshots"  # table property: folders of the versions kept, newest first
_NEXT, _BEFORE = "__next", "__before"  # tables that exist only while a schema changes


def qualified(db: str, table: str) -> str:
    return f"{quote(sanitize_identifier(db))}.{quote(table)}"


def create_database(spark: SparkSession, db: str) -> str:
    """K1."""
    name = sanitize_identifier(db)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote(name)}")
    return name


def _exists(spark: SparkSession, name: str) -> bool:
    """Whether the table can be read; only a missing one counts as absent."""
    try:
        return spark.catalog.tableExists(name)
    except AnalysisException as err:
        if (err.getCondition() or "") not in ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND"):
            raise
        return False


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    """Provider, type and location of a table, as the catalog states them."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name IN ('Provider', 'Type', 'Location')").collect()
    return {r["col_name"]: r["data_type"] for r in rows}


def snapshots_of(spark: SparkSession, db: str, table: str) -> list[str]:
    """Folders of the versions that are kept, newest first (none for a table
    that this library did not publish)."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {qualified(db, table)}").where(f"key = '{_SNAPSHOTS}'").collect()
    return [f for f in rows[0]["value"].split("\n") if f] if rows else []


def drop_table(spark: SparkSession, db: str, table: str) -> None:
    """K2: drop a table and the versions that were published to it."""
    name = qualified(db, table)
    kept = snapshots_of(spark, db, table) if _exists(spark, name) else []
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for folder in kept:
        remove_folder(spark, folder, sanitize_identifier(db))


def _base_folder(spark: SparkSession, db: str, table: str, location: str | None) -> str:
    if location is not None:
        return location.rstrip("/")
    return f"{spark.catalog.getDatabase(sanitize_identifier(db)).locationUri.rstrip('/')}/{table}"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _point_table(spark: SparkSession, db: str, table: str, fmt: str, schema: T.StructType, folder: str) -> None:
    """Make ``table`` read ``folder``. With the same columns this is one
    ``SET LOCATION``. Other columns or another format need a new catalog entry:
    it is made under another name, and two renames put it in the old one's
    place; :func:`_heal` undoes a swap that broke off between the two."""
    name = qualified(db, table)

    def create(target: str) -> None:
        spark.catalog.createTable(target, path=folder, source=fmt, schema=schema)

    if not _exists(spark, name):
        create(name)
        return
    now = _described(spark, name)
    if now.get("Type") == "VIEW":
        raise ValueError(f"{name} is a view, not a table")
    same = [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in schema]
    if same and (now.get("Provider") or "").lower() == fmt.lower():
        spark.sql(f"ALTER TABLE {name} SET LOCATION {_text(folder)}")
    else:
        fresh, old = qualified(db, table + _NEXT), qualified(db, table + _BEFORE)
        spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        create(fresh)
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        try:
            spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        except Exception:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
            raise
        spark.sql(f"DROP TABLE {old}")
    spark.catalog.refreshTable(name)


def _heal(spark: SparkSession, db: str, table: str) -> None:
    """After a publish that was killed between its two renames: the old rows
    take their name again."""
    name, old = qualified(db, table), qualified(db, table + _BEFORE)
    if _exists(spark, old):
        spark.sql(f"DROP TABLE {old}" if _exists(spark, name) else f"ALTER TABLE {old} RENAME TO {name}")


def overwrite_table(df: DataFrame, db: str, table: str, fmt: str = "parquet",
                    location: str | None = None, keep: int = 1) -> str:
    """K3: replace a catalog table (data and schema). Versions are folders under
    ``location`` (shared storage), or under the database's folder. ``keep``
    versions before the new one stay readable for whoever began with them.

    If the write fails, the table and all its versions stay as they were and
    the unfinished folder is removed. Of two publishers at once the later
    catalog statement wins, with whole rows; both count as versions.
    """
    spark, name = df.sparkSession, qualified(db, table)
    _heal(spark, db, table)
    stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    folder = f"{_base_folder(spark, db, table, location)}/snapshot-{stamp}-{uuid.uuid4().hex[:12]}"
    try:
        df.write.format(fmt).save(folder)
    except Exception:
        remove_folder(spark, folder, sanitize_identifier(db))
        raise
    before = snapshots_of(spark, db, table) if _exists(spark, name) else []
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema])
    _point_table(spark, db, table, fmt, schema, folder)
    left = []
    for old in before[keep:]:
        try:
            remove_folder(spark, old, sanitize_identifier(db))
        except AnalysisException:  # the new rows are published: the next one tries again
            left.append(old)
    # last: a publisher that dies before this leaves folders behind, no wrong list
    kept = "\n".join([folder, *before[:keep], *left])
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({_text(_SNAPSHOTS)} = {_text(kept)})")
    return name


@contextmanager
def exclusive(spark: SparkSession, db: str, table: str, wait: float = 600.0, stale: float = 3600.0, poll: float = 0.2):
    """One writer at a time for a read-change-publish of ``table``.

    The lock is a catalog table ``<table>__lock``: creating it succeeds for one
    of all callers, whatever session or cluster they run on, if they share the
    catalog. Others try again until ``wait`` seconds have passed
    (``TimeoutError``). A lock whose owner died is broken ``stale`` seconds after
    it was taken; hold it for less than that.
    """
    name, owner = qualified(db, table + "__lock"), uuid.uuid4().hex
    create_database(spark, db)
    began = time.time()
    while True:
        try:
            spark.sql(f"CREATE TABLE {name} (x INT) USING parquet TBLPROPERTIES ('lock.owner' = '{owner}', 'lock.until' = '{time.time() + stale}')")
            break
        except AnalysisException as err:
            if "ALREADY_EXISTS" not in (err.getCondition() or ""):
                raise
        held = _lock(spark, name)
        if held and float(held["lock.until"]) < time.time():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif time.time() - began > wait:
            raise TimeoutError(f"{name} is held since more than {wait} seconds")
        else:
            time.sleep(poll)
    try:
        yield
    finally:
        if _lock(spark, name).get("lock.owner") == owner:  # else it was broken as stale
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _lock(spark: SparkSession, name: str) -> dict[str, str]:
    """Owner and end of a lock; empty if it has just been released."""
    try:
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    except AnalysisException as err:
        if err.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            raise
        return {}
    return found if "lock.until" in found else {}


def publish(df: DataFrame, db: str, table: str, fmt: str = "parquet",
            location: str | None = None) -> DataFrame:
    """K4: create database, replace table, return a frame reading it back. The
    frame reads the version just published, also after the next one, and the
    plan may read the table it replaces."""
    spark = df.sparkSession
    create_database(spark, db)
    return spark.table(overwrite_table(df, db, table, fmt, location))


def publish_many(df: DataFrame, db: str, tables: Sequence[str], fmt: str = "parquet",
                 locations: Sequence[str] | None = None) -> list[DataFrame]:
    """K5: the same result into several tables, computed once.

    The first table is written from ``df``; the others are copied from that
    table, so the upstream work (scoring) runs once and later writes read
    finished files instead of a lineage that a lost executor would replay.
    """
    if not tables:
        return []
    locs = list(locations) if locations is not None else [None] * len(tables)
    first = publish(df, db, tables[0], fmt, locs[0])
    return [first, *publish_copies(first, db, tables[1:], fmt, locs[1:])]


def publish_copies(published: DataFrame, db: str, tables: Sequence[str], fmt: str = "parquet",
                   locations: Sequence[str | None] | None = None) -> list[DataFrame]:
    """Copy an already published table into ``tables``. The copies are
    independent jobs over finished files, submitted together so the scheduler
    can overlap them."""
    if not tables:
        return []
    locs = list(locations) if locations is not None else [None] * len(tables)
    with ThreadPoolExecutor(max_workers=min(4, len(tables))) as pool:
        return list(pool.map(lambda tl: publish(published, db, tl[0], fmt, tl[1]),
                             zip(tables, locs)))


def append_table(df: DataFrame, db: str, table: str, fmt: str = "parquet",
                 location: str | None = None) -> DataFrame:
    """Append rows to a catalog table, creating database and table if needed
    (run logs and other ledgers)."""
    spark = df.sparkSession
    create_database(spark, db)
    writer = df.write.format(fmt).mode("append")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(qualified(db, table))
    return spark.table(qualified(db, table))


def table_or_none(spark: SparkSession, db: str, table: str) -> DataFrame | None:
    name = qualified(db, table)
    _heal(spark, db, table)
    return spark.table(name) if _exists(spark, name) else None


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """K6: the first ``n`` rows, for display."""
    return df.limit(n)

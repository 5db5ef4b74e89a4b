"""Session helpers (S7): one session per process, plus a shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None
_PROCESS, _REMOVING = uuid.uuid4().hex[:12], threading.Lock()
_SCOPE: ContextVar[list[str] | None] = ContextVar("vintner_scratch_scope", default=None)


def get_session(master: str | None = None, app_name: str = "vintner",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one.

    Reuses an ambient session (a notebook's ``spark``) when there is one. The UI
    stays off, time zone is UTC and AQE is on; ANSI mode keeps Spark's default.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        ensure_checkpoint_dir(active)
        return active
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is set by the operator and points at shared storage. Only
    when it is unset and the master is local (tests) do we create one under the
    system temp folder; elsewhere an unset folder is an error.
    """
    global _LOCAL_SCRATCH
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        sc = None
    if sc is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="vintner-ckpt-")
    sc.setCheckpointDir(_LOCAL_SCRATCH)
    return sc.getCheckpointDir() or _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A path for a written intermediate table: under the shared checkpoint
    folder, in one sub-folder per application (so an application's scratch
    can be removed in one go once it has finished; :func:`scratch_scope`
    removes what a job wrote)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        app = "session"
    leaf = f"{name}-{uuid.uuid4().hex[:12]}" if unique else name
    path = f"{base}/vintner/{app}/{leaf}"
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later steps read compact columnar files instead of replaying the
    lineage, and a lost executor costs a re-read, not a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str, db: str = "default") -> None:
    """Remove a folder on any storage Spark reaches, by SQL alone: a throw-away
    managed table in ``db`` is pointed at the folder and dropped, and the catalog
    removes a managed table's files. The table has a name of this process, so
    callers do not meet (threads take turns). A folder that is not there is no
    error."""
    name = f"`{db.replace('`', '``')}`.`vintner__removed_{_PROCESS}`"
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    with _REMOVING:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} (x INT) USING parquet")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{place}'")
        spark.sql(f"DROP TABLE {name}")


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch written inside the block is removed when it ends, also when it
    fails. For jobs whose results are published by then: a frame over a removed
    intermediate can no longer be read. Blocks may nest; a path belongs to the
    innermost one of its thread."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        for path in paths:
            remove_folder(spark, path)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """L3: keep ``df`` cached for the block and release it afterwards (the
    cache is dropped even if the block fails). Cache the typed, pruned frame,
    not the raw input. Lost blocks are recomputed from lineage; for reuse
    across many steps or to cut lineage, prefer :func:`materialize`."""
    cached = df.persist(level)
    try:
        yield cached
    finally:
        cached.unpersist()

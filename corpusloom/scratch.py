"""Staging through the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}

#: Spark removes the shuffle files of a query when it ends; they serve nothing once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir.

    A local session without that setting gets a temporary folder; a cluster session without it is an
    error, since no machine-local folder would be visible to the others.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="corpusloom-")
        _ROOTS[app] = f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(delete, spark, _ROOTS[app])
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def delete(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


class Staged:
    """A table written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.path)


class _Cleaning:
    """While any query is being staged, the session removes shuffle files as queries end; then its own setting is back.

    Stages may overlap in several threads: the first one in keeps the session's setting, the last one out restores it.
    """

    def __init__(self):
        self.lock, self.open, self.before = threading.Lock(), {}, {}

    @contextmanager
    def of(self, spark: SparkSession):
        key = spark._jsparkSession.hashCode()
        with self.lock:
            if not self.open.get(key):
                self.before[key] = spark.conf.get(CLEANUP, None)
                spark.conf.set(CLEANUP, "true")
            self.open[key] = self.open.get(key, 0) + 1
        try:
            yield
        finally:
            with self.lock:
                self.open[key] -= 1
                if not self.open[key]:
                    before = self.before.pop(key)
                    spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_CLEANING = _Cleaning()


def stage(df: DataFrame, name: str) -> Staged:
    """Write df once as Parquet in the shared folder and read it back: this cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _CLEANING.of(spark):
        df.write.option("compression", "zstd").parquet(path)
    return Staged(spark, path)

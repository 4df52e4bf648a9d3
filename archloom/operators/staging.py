"""Lineage cut by tables in the cluster's shared folder (spark.checkpoint.dir), deleted when the process ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Has Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a full URI; one without a scheme is on the default file system, as Hadoop has it.

    Where the session names none (neither spark.checkpoint.dir nor setCheckpointDir), a master that runs in this process
    gets a temporary folder, as tests do; on a cluster that is an error, since executors don't share this machine's disk.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="archloom-")
        _written.append((spark, own))
        sc.setCheckpointDir(own)
        at = sc.getCheckpointDir() or own
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut_lineage(df: DataFrame, name: str = "staged") -> DataFrame:
    """df, written to the shared folder and read back: later plans start at this table."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame of cut_lineage() that no later plan reads."""
    if path := getattr(df, "_staged_at", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return

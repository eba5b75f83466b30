"""Storage that the driver and all executors share.

``spark.checkpoint.dir`` names it. Only where that is unset and the master is a
single local JVM do we fall back to a folder of our own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Intermediate tables that are left, by application.
_LEFT: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Raises where a cluster names none."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        where = named
    else:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gaugewell-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{shared_dir(spark).rstrip('/')}/gaugewell-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until discard() or clean(): results that are read from it later need it.
    The shuffle files of the write are deleted with its end, not when the driver next
    collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _LEFT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gaugewell_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a DataFrame of materialise() that nothing reads any more."""
    _LEFT.get(df.sparkSession.sparkContext.applicationId, set()).discard(df._gaugewell_path)
    remove(df.sparkSession, df._gaugewell_path)


def clean(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application, when its results have been read; their number."""
    paths = _LEFT.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        remove(spark, path)
    return len(paths)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by new_path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

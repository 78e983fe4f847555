"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is this machine (tests), a temporary folder; on a cluster there is
    no folder that all nodes could read, so that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _local[app]


def _target(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def durable(df: DataFrame, name: str, after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation of what came before.
    The durable tables ``after`` aren't read any more once this one is written, and go then; all go when
    the application ends. What the write passes to Python goes in batches of ``BATCH_BYTES``, so that a
    batch of long texts doesn't fill an executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    fs, target = _target(spark, path)
    fs.deleteOnExit(target)
    for old in after:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` to Python for the rest of the session, for results that a caller writes: whole texts would else fill an executor."""
    spark.conf.set(_BATCH, BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for what goes when the application ends."""
    path = f"{shared_folder(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    fs, target = _target(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def discard(table: DataFrame) -> None:
    """Deletes the files of a durable table that nothing reads any more."""
    fs, target = _target(table.sparkSession, table.durable_path)
    fs.delete(target, True)

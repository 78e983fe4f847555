"""Live progress: new log rows as they arrive, each id once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, name: str | None, schema, ts: str = "ts", late: str = "1 hour", files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files ``name`` (a glob; None: all) of a folder, with an event time; ids that come again within ``late`` are dropped by :func:`once`."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    read = (read.option("pathGlobFilter", name) if name else read).parquet(folder)
    return read.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)


def table_stream(spark: SparkSession, folder: str, name: str, schema, **more) -> DataFrame:
    """A stream of the table ``name`` in ``folder``, be it one file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    parts = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return log_stream(spark, f"{folder}/{name}" if parts else folder, None if parts else name, schema, **more)


def once(logs: DataFrame, key: str) -> DataFrame:
    """Replayed rows go; the state kept is that of the watermark's span."""
    return logs.dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what there is and returns what it wrote under ``folder``."""
    spark = stream.sparkSession
    out = f"{folder}/tail-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")

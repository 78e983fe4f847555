"""Logs kept for replay: a client that comes back reads the files from its offset on, and no others.

Files are ranged by session and place, so a session's logs lie in a few neighbouring files; an index with one
row a file says which. It is sparse: its size follows the number of files, not of logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = "first", "last"


def write_logs(logs: DataFrame, folder: str, session: str, seq: str, files: int | None = None) -> None:
    """Writes ``logs`` as about ``files`` files (by default as many as the session's shuffles have) and their index under ``folder``.

    A large session takes several files, as it is cut by ``seq`` too. Null sessions come first.
    """
    spark = logs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs.repartitionByRange(n, session, seq).sortWithinPartitions(session, seq).write.parquet(f"{folder}/logs")
    place = F.struct(F.col(session).alias("session"), F.col(seq).alias("seq"))
    kept = spark.read.schema(logs.schema).parquet(f"{folder}/logs").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), place.alias("place"))
    kept.groupBy("file").agg(F.min("place").alias(FIRST), F.max("place").alias(LAST)).coalesce(1).write.parquet(f"{folder}/index")


def _wanted(index: DataFrame, session: Column, after: Column) -> Column:
    """Whether a file may hold a session's logs past a place."""
    known = (F.col(f"{FIRST}.session") < session) | F.col(f"{FIRST}.session").isNull() | (F.col(f"{FIRST}.session") == session)
    return known & ((F.col(f"{LAST}.session") > session) | ((F.col(f"{LAST}.session") == session) & (F.col(f"{LAST}.seq") > after)))


def replay(spark: SparkSession, folder: str, session, after: int, name: str = "session", seq: str = "seq") -> DataFrame:
    """The logs of a session behind the place ``after``, read from their files alone.

    A session without any has no rows. The order of rows is that of ``seq``, by which the client sorts.
    """
    index = spark.read.parquet(f"{folder}/index")
    files = [r.file for r in index.where(_wanted(index, F.lit(session), F.lit(after))).select("file").collect()]  # those of one session
    schema = spark.read.parquet(f"{folder}/logs").schema
    found = spark.read.schema(schema).parquet(*[f"{folder}/logs/{f}" for f in files]) if files else spark.createDataFrame([], schema)
    return found.where((F.col(name) == F.lit(session)) & (F.col(seq) > after))


def replay_all(spark: SparkSession, folder: str, offsets: DataFrame, name: str = "session", seq: str = "seq", after: str = "after") -> DataFrame:
    """The logs that each of many clients (session, after) has not seen yet, a row for each client that lacks it.

    A client without an offset (null) has seen nothing. Files before every client's offset, by the index, aren't
    read; logs and clients meet by session.
    """
    known = offsets.select(F.col(name).alias("__session"), F.coalesce(after, F.lit(-(1 << 63))).alias("__after"))
    first = known.groupBy("__session").agg(F.min("__after").alias("__after"))
    index = spark.read.parquet(f"{folder}/index")
    # a file of one session is skipped where all its clients are past it; files where sessions meet are read
    own = index.where(F.col(f"{FIRST}.session") == F.col(f"{LAST}.session")).select("file", F.col(f"{LAST}.session").alias("__session"), F.col(f"{LAST}.seq").alias("end"))
    past = [r.file for r in own.join(first, "__session").where(F.col("end") <= F.col("__after")).select("file").collect()]  # files at most
    names = [r.file for r in index.select("file").collect() if r.file not in set(past)]
    schema = spark.read.parquet(f"{folder}/logs").schema
    logs = spark.read.schema(schema).parquet(*[f"{folder}/logs/{n}" for n in names]) if names else spark.createDataFrame([], schema)
    return logs.join(known, (F.col(name) == F.col("__session")) & (F.col(seq) > F.col("__after"))).drop("__session", "__after")

"""Contiguous shards of near equal bytes, by a global prefix sum.

The rows' sizes (never the texts) are range-partitioned by id. Totals per partition give each
partition its offset; a running sum inside the partition gives each row its place in the whole. Equal
byte targets cut that line into shards. Built from DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._shared import durable, plain_text


def byte_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard``, ``slot``, ``start_byte``.

    Rows stand in the order of id (nulls first), then checksum, then size; rows equal in all three
    are interchangeable. ``size`` is the text's UTF-8 bytes plus 1; a null or empty text has size 1 and
    checksum 0. A shard takes the rows whose first byte lies in its equal share of all bytes, so two
    shards differ by at most the largest row. ``slot`` counts from 0 without a gap within a shard. An
    empty table gives an empty result; with fewer rows than shards some shards stay empty. Other
    columns are not read.
    """
    text = plain_text(F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["id", "text_crc32", "size", "place"]
    ranged = sized.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    # written once, so that the totals and the running sums see the same partitions
    ranged = durable(ranged.withColumn("part", F.spark_partition_id()), "shard-sizes")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # one row per partition: the only thing that is summed in one place
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )

    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = ranged.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("bytes_in"),
        (F.row_number().over(inside) - 1).alias("row_in"),
    )
    cut = placed.join(F.broadcast(offsets), "part").select(
        "id", "size", "text_crc32",
        (F.col("bytes_before") + F.col("bytes_in")).alias("start_byte"),
        (F.col("rows_before") + F.col("row_in")).alias("row"),
        F.expr(f"cast(((bytes_before + bytes_in) * {n_shards}) div all_bytes as int)").alias("shard"),
    )
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "start_byte"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` with all columns under ``path/shard=K``, within a shard in the order of its slots.

    A column of ``docs`` called shard is written as ``shard_`` (with as many underscores as it takes).
    Rows that repeat an id and a size and checksum of the text are interchangeable: each is written once.
    Null ids and texts are written like any other; an empty table writes no rows.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    text = plain_text(F.col(text_col))
    # the n-th of equal rows takes the n-th of their places
    keys = ("id", "size", "text_crc32")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("order")).alias("nth")
    packed = docs.select(own, F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("order"))
    where = byte_shards(docs, n_shards, id_col, text_col).select(F.col(id_col).alias("id"), "size", "text_crc32", "shard", "slot", F.col("slot").alias("order"))
    rows, places = packed.select(*keys, nth, "own"), where.select(*[F.col(k).alias(f"{k}_") for k in keys], "shard", "slot", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "order")).alias("nth_"))
    joined = rows.join(places, (F.col("nth") == F.col("nth_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("size") == F.col("size_")) & (F.col("text_crc32") == F.col("text_crc32_")))
    taken = {c.lower() for c in docs.columns}
    name = lambda c: c if c.lower() != "shard" else next(x for k in range(1, 99) if (x := c + "_" * k).lower() not in taken)
    dealt = joined.repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(64))).sortWithinPartitions("shard", "slot")
    dealt.select(*[F.col(f"own.`{c}`").alias(name(c)) for c in docs.columns], "shard").write.partitionBy("shard").parquet(path)

"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import bounded_batches, discard, durable, shared_folder

__all__ = ["SPACES", "bitmap", "bounded_batches", "discard", "durable", "join_facts", "maybe_in", "plain_text", "read_table", "shared_folder", "with_counts"]

#: A run of the six ASCII white-space characters, as a Java pattern.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_text(column: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def with_counts(rows: DataFrame, key: str, value: str, more=None, salts: int = 32) -> DataFrame:
    """Adds ``n`` (rows) and ``least`` (smallest ``value``) of each row's group of equal ``key``, and its ``salt``.

    A group may hold a third of all rows, so each group is dealt over ``salts`` sub-groups: they are
    aggregated first, and the facts return to the rows by (key, salt). ``more`` may turn the facts into
    others, one row per key, with the column ``key``. The joins are merges: ``rows`` may come of an explode,
    after which Spark takes them for as few as before and would broadcast them.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col(value)), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("part_n"), F.min(value).alias("part_least"))
    facts = parts.groupBy(key).agg(F.sum("part_n").alias("n"), F.min("part_least").alias("least"))
    per_salt = parts.select(key, "salt").join((more(facts) if more else facts).hint("merge"), key)
    return salted.join(per_salt.hint("merge"), [key, "salt"])


#: Positions of a native bitmap: at most BITMAP_BITS / 64 rows of two numbers, some 16 MB, are broadcast.
BITMAP_BITS = 1 << 25
#: A key with more than this part of all rows is hot; there are HOT of them at most.
HOT = 1000


def _slot(hashes: str) -> Column:
    return F.expr(f"cast(shiftright(pmod({hashes}, {BITMAP_BITS}L), 6) as int)")


def _bit(hashes: str) -> str:
    return f"cast(pmod({hashes}, 64L) as int)"


def bitmap(keys: DataFrame, hashes: str) -> DataFrame:
    """(slot, bits): the positions that the 64-bit hashes of a column hit. Of bounded size, whatever the keys."""
    return keys.select(_slot(hashes).alias("slot"), F.expr(f"shiftleft(1L, {_bit(hashes)})").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def maybe_in(rows: DataFrame, hashes: str, marked: DataFrame) -> DataFrame:
    """The rows with a column ``maybe``: false where a bitmap says that the hash isn't among its keys."""
    joined = rows.withColumn("slot", _slot(hashes)).join(F.broadcast(marked), "slot", "left")
    return joined.withColumn("maybe", F.expr(f"coalesce(shiftrightunsigned(bits, {_bit(hashes)}) & 1L = 1L, false)")).drop("slot", "bits")


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with facts (one row per key, ``n``: how many of ``total`` rows it has).

    The facts of hot keys, ``HOT`` at most, are broadcast; no other key fills a task. The rest is merged.
    """
    hot = facts.where(F.col("n") * HOT > total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col("n") * HOT <= total).hint("merge"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest).drop("n")

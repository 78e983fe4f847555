"""Exact deduplication with a two-pass Bloom filter.

Pass one inserts the hash of every normalised text into a filter whose positions count none, once or
"twice or more". Pass two probes it: a row all of whose positions were hit twice is *possibly*
repeated. Only those rows shuffle and are grouped exactly (by SHA-256); every other row is certainly
unique and passes straight through.

The filter is built where the rows are: a task sends the positions it hit, in segments of 65,536;
the segments are merged by segment number. What is broadcast is one bit a position. Its size follows
the number of rows up to ``max_filter_bits``, a fixed bound; beyond it the filter fills up, more
unique rows take the exact path, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import SPACES, durable, plain_text, with_counts

PROBES = 3
BITS_PER_ROW = 12
SEGMENT = 1 << 16
MAX_FILTER_BITS = 1 << 30


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The ``PROBES`` filter positions of each 64-bit hash, one row a probe."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * high) & np.uint64(bits - 1) for i in range(PROBES)])


def _local_hits(bits: int):
    """Per task: which positions its rows hit once, and which more often, by segment."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not (seen := [x for x in seen if len(x)]):
            return
        at, n = np.unique(np.concatenate([positions(x, bits).ravel() for x in seen]), return_counts=True)
        segment = (at // SEGMENT).astype(np.int64)
        cuts = np.flatnonzero(np.diff(segment, prepend=-1))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            low = (at[a:b] % SEGMENT).astype("<u2")
            rows.append((int(segment[a]), low.tobytes(), low[n[a:b] > 1].tobytes()))
        for k in range(0, len(rows), 1024):
            part = list(zip(*rows[k : k + 1024]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], ["segment", "hit", "again"])

    return hits


def _merge(times: int):
    """Merges the hits of all tasks; the bits of a segment that were hit so often remain."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, hit, again in zip(*(c.to_pylist() for c in batch.columns)):
                one = once.setdefault(segment, np.zeros(SEGMENT, bool))
                two = twice.setdefault(segment, np.zeros(SEGMENT, bool))
                at = np.frombuffer(hit, "<u2")
                two[at[one[at]]] = True
                two[np.frombuffer(again, "<u2")] = True
                one[at] = True
        for segment, bits in (twice if times > 1 else once).items():
            if bits.any():
                packed = np.packbits(bits, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([packed], pa.binary())], ["segment", "bits"])

    return merge


def repeat_filter(hashes: DataFrame, column: str = "h", max_filter_bits: int = MAX_FILTER_BITS, times: int = 2):
    """A boolean Column function: may this hash occur ``times`` (1 or 2) times or more in ``hashes``?

    Never false for a hash that does.
    """
    spark = hashes.sparkSession
    rows = hashes.count()
    bits = SEGMENT
    while bits < min(rows * BITS_PER_ROW, max_filter_bits):
        bits *= 2
    bits = min(bits, max(SEGMENT, max_filter_bits))
    hits = hashes.select(column).mapInArrow(_local_hits(bits), "segment long, hit binary, again binary")
    merged = hits.repartition("segment").mapInArrow(_merge(times), "segment long, bits binary")
    filled = np.zeros(bits // 8, np.uint8)
    for segment, packed in merged.collect():  # bits / 8 bytes at most
        filled[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(packed, np.uint8)
    sent = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def possibly_repeated(h: pd.Series) -> pd.Series:
        at = positions(h.to_numpy(np.int64), bits)
        return pd.Series(((sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))

    return possibly_repeated


def normalised(text):
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(plain_text(text), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after white-space normalisation. Null and empty texts are
    one group. Of a group the smallest id stays; a null id never stays beside a real one, and if all
    ids of a group are null, those rows stay. Rows that repeat an id of their own group all carry the
    same verdict and count in ``group_size``. An empty table gives an empty result. Columns other than
    the two named ones are not read.
    """
    norm = normalised(F.col(text_col))
    hashed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.xxhash64(norm).alias("h"))
    hashed = durable(hashed, "exact-hashes")
    maybe = repeat_filter(hashed, "h", max_filter_bits)(F.col("h"))
    flagged = hashed.withColumn("maybe", maybe)
    alone = flagged.where(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    repeated = with_counts(flagged.where("maybe").select("id", "sha"), "sha", "id")
    both = alone.unionByName(repeated.select("id", "sha", F.col("least").alias("keep_id"), F.col("n").alias("group_size")))
    return both.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row a group of equal texts.

    Rows that the filter clears are not shuffled at all. Edge cases are as in :func:`exact_groups`, but
    of rows that repeat both id and text one stays.
    """
    names = docs.columns
    norm = normalised(F.col(text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    packed = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(norm).alias("h"))
    hashed = durable(packed.select("h"), "exact-h")
    maybe = repeat_filter(hashed, "h", max_filter_bits)(F.col("h"))
    flagged = packed.withColumn("maybe", maybe)
    alone = flagged.where(~F.col("maybe")).select("row.*")
    possible = flagged.where("maybe").select("row", "id", F.sha2(normalised(F.col(f"row.`{text_col}`")), 256).alias("sha"))
    # the smallest id of a group, then one row for it: nothing but ids and hashes meets in a group
    keep = durable(possible.groupBy("sha").agg(F.min("id").alias("keep_id")), "exact-keep")
    stays = possible.join(keep, (possible.sha == keep.sha) & possible.id.eqNullSafe(keep.keep_id), "left_semi")
    stays = stays.groupBy("sha").agg(F.first("row").alias("row")).select("row.*")
    return alone.unionByName(stays)

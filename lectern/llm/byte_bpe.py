"""Byte-level BPE encoding and decoding, by whole words first and by merges of bytes for the rest.

A text is cut by the vocabulary's pattern. The distinct pieces of a slice of texts go through two tiers:
a minimal perfect hash over the vocabulary finds all pieces that are one token, a whole slice at a time in
numpy; each other piece is merged by a heap of adjacent pairs over linked bytes, lowest rank first and
leftmost of equals. The hash is built once on the driver and broadcast: its size is that of the
vocabulary file, whatever the corpus.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm._shared import plain_text
from lectern.llm._tokens import mix, small

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keys of at most NARROW bytes are looked up apart from longer ones, so that few bytes are padding.
NARROW = 16
#: Merged pieces that a worker remembers, twice over at most, of at most REMEMBERED_BYTES bytes each; texts of more than LONG characters are cut piece by piece.
REMEMBERED, REMEMBERED_BYTES, LONG, PIECES = 400_000, 64, 1 << 20, 1 << 16


class PerfectHash:
    """A minimal perfect hash: n distinct byte strings take the places 0 to n - 1.

    Keys fall into buckets by one hash. From the largest bucket down, a displacement is searched that sends
    all keys of the bucket to free places; a bucket of one key names a free place itself. The keys are kept
    in their places, so that a string that is no key is told apart by comparison.
    """

    PER_BUCKET = 3

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        if len(set(keys)) != self.n:
            raise ValueError("the keys of a perfect hash must be distinct")
        longest = max(map(len, keys), default=0)
        self.width = max(NARROW, -(-longest // 8) * 8)
        for seed in range(64):
            self.seed = np.uint64(seed)
            hashes, words, lengths = self._hashed(keys, self.width)
            if len(np.unique(hashes)) == self.n and self._place(hashes):
                break
        else:
            raise ValueError("no seed tells the keys apart")
        self.words, self.lengths = np.zeros_like(words), np.zeros_like(lengths)
        at = self._slots(hashes)
        self.words[at], self.lengths[at] = words, lengths
        self.places = at  # of the keys as given

    def _hashed(self, keys: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit hash of each key, the keys as rows of 8-byte numbers padded with zeros, and their lengths."""
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        words = np.array(keys, f"S{width}").view("<u8").reshape(len(keys), width // 8)
        hashes = mix(lengths.astype(np.uint64) * _STEP + self.seed)
        for k in range(width // 8):
            more = lengths > 8 * k
            if not more.any():
                break
            hashes = np.where(more, mix(hashes ^ words[:, k]), hashes)
        return hashes, words, lengths

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(len(self.moves))).astype(np.int64)

    def _moved(self, hashes: np.ndarray, move: np.ndarray) -> np.ndarray:
        return (mix(hashes + (move.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(self.n)).astype(np.int64)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        move = self.moves[self._bucket(hashes)]
        return np.where(move < 0, -move - 1, self._moved(hashes, np.maximum(move, 0)))

    def _place(self, hashes: np.ndarray, tries: int = 256, rounds: int = 400) -> bool:
        self.moves = np.zeros(max(1, -(-self.n // self.PER_BUCKET)), np.int64)
        if not self.n:
            return True
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(len(self.moves) + 1))
        sizes = np.diff(starts)
        taken = np.zeros(self.n, bool)
        single = []
        for b in np.argsort(-sizes, kind="stable"):
            own = hashes[order[starts[b] : starts[b + 1]]]
            if len(own) < 2:
                single += [b] if len(own) else []
                continue
            for at in range(0, tries * rounds, tries):
                moves = np.arange(at, at + tries)
                places = np.sort(self._moved(own[None, :], moves[:, None]), axis=1)
                good = np.flatnonzero(~taken[places].any(axis=1) & (places[:, 1:] != places[:, :-1]).all(axis=1))
                if len(good):
                    self.moves[b] = moves[good[0]]
                    taken[places[good[0]]] = True
                    break
            else:
                return False
        self.moves[single] = -np.flatnonzero(~taken)[: len(single)] - 1
        return True

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The place of each string that is a key, and -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        for low, width in ((-1, NARROW), (NARROW, self.width)):
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(some):
                hashes, words, own = self._hashed([keys[k] for k in some], width)
                at = self._slots(hashes)
                same = (self.lengths[at] == own) & (self.words[at, : width // 8] == words).all(axis=1)
                out[some] = np.where(same, at, -1)
        return out


class Vocabulary:
    """Ranks of byte strings, their perfect hash and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        self.pattern, self._coder = pattern, None
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.ids = np.zeros(len(keys), "<u4")
        self.ids[self.hash.places] = list(ranks.values())

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A file of lines with a token in base64, a space, and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, pattern)

    def coder(self) -> Coder:
        """One coder a process, so that its tables are made once and tasks share the pieces merged so far."""
        if self._coder is None:
            self._coder = Coder(self)
        return self._coder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coder": None}


class Coder:
    """What a task needs besides the vocabulary: the tables for merges and decoding, and the pieces merged so far."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.cut = vocabulary, regex.compile(vocabulary.pattern)
        table = vocabulary.hash
        keys = [w.tobytes()[:n] for w, n in zip(table.words, table.lengths)]
        ranks = dict(zip(keys, vocabulary.ids.tolist()))
        self.surface = {i: k for k, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.two = {(k[0], k[1]): i for k, i in ranks.items() if len(k) == 2}
        self.packed = [struct.pack("<I", i) for i in vocabulary.ids.tolist()]  # by place in the hash
        self.many = max(self.surface) + 1
        self.joins = {}  # two tokens to the token of both
        for key, made in ranks.items():
            for at in range(1, len(key)):
                a, b = ranks.get(key[:at]), ranks.get(key[at:])
                if a is not None and b is not None:
                    self.joins[a * self.many + b] = made
        self.merged: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of a piece that is none itself: pairs join by lowest rank, the leftmost of equals."""
        n, joins, many, symbols = len(piece), self.joins, self.many, list(map(self.single.__getitem__, piece))
        shift = n.bit_length()
        mask = (1 << shift) - 1
        # of symbols by their first byte: the next and the last one, and the agenda's entry of the pair that the symbol begins
        after, before, entry = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        two = map(self.two.get, zip(piece, piece[1:]))
        agenda = [made << shift | i for i, made in enumerate(two) if made is not None]
        for e in agenda:
            entry[e & mask] = e
        heapify(agenda)
        while agenda:
            e = heappop(agenda)
            i = e & mask
            if entry[i] != e:
                continue
            j, made = after[i], e >> shift
            k = after[i] = after[j]
            symbols[i], symbols[j], entry[i], entry[j] = made, -1, -1, -1
            if k < n:
                before[k] = i
                new = joins.get(made * many + symbols[k])
                if new is not None:
                    entry[i] = e = new << shift | i
                    heappush(agenda, e)
            h = before[i]
            if h >= 0:
                new = joins.get(symbols[h] * many + made)
                if new is None:
                    entry[h] = -1
                else:
                    entry[h] = e = new << shift | h
                    heappush(agenda, e)
        return [s for s in symbols if s >= 0]

    def resolve(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed tokens of distinct pieces."""
        if len(self.merged) > REMEMBERED:  # what was needed since stays for another round
            self.merged, self.older = {}, self.merged
        merged, older = self.merged, self.older
        out = {name: merged[name] for name in pieces & merged.keys()}
        rest = pieces - out.keys()
        for name in rest & older.keys():
            out[name] = merged[name] = older[name]
        names = list(rest - older.keys())
        keys = [x.encode() for x in names]
        for name, key, place in zip(names, keys, self.vocabulary.hash.find(keys).tolist()):
            if place >= 0:
                out[name] = self.packed[place]
                continue
            own = self.merge(key)
            out[name] = found = struct.pack(f"<{len(own)}I", *own)
            if len(key) <= REMEMBERED_BYTES:
                merged[name] = found
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The tokens of each text, as little-endian unsigned 32-bit numbers."""
        cut = [self.cut.findall(x) if len(x) <= LONG else [] for x in texts]
        known = self.resolve(set().union(*cut))
        out = [b"".join([known[p] for p in pieces]) for pieces in cut]
        for k, text in enumerate(texts):
            if len(text) > LONG:
                parts, matches = [], self.cut.finditer(text)
                while pieces := [m[0] for m in islice(matches, PIECES)]:
                    known = self.resolve(set(pieces))
                    parts.append(b"".join([known[p] for p in pieces]))
                out[k] = b"".join(parts)
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed tokens; a number that is no token is an error."""
        surface = self.surface
        return b"".join([surface[i] for i in np.frombuffer(packed, "<u4").tolist()])


def _coded(vocabulary, packed: bool):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.value.coder()
        for part in small(batches, 1024, 2 << 20):
            ids = coder.encode(part.column(1).to_pylist())
            if packed:
                column = pa.array(ids, pa.binary())
            else:
                cuts = np.cumsum([0] + [len(x) // 4 for x in ids])
                column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(map(coder.decode, ids), pa.binary())], ["id", "ids", "decoded"])

    return coded


def encode_bytes(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """One row per input row: id, ``ids`` (without special tokens), ``decoded`` (the bytes of those ids).

    The ids are an array of longs, or, if ``packed``, one binary of little-endian unsigned 32-bit numbers.

    Whole texts are encoded, whatever their length; the strings of special tokens are ordinary text. Null
    and empty texts have no ids and decode to no bytes. Rows are independent, so repeated rows and ids are
    kept. An empty table gives an empty result. Columns other than the two named ones are not read.
    """
    spark: SparkSession = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    shared = spark.sparkContext.broadcast(vocabulary)
    kind = "binary" if packed else "array<long>"
    coded = named.mapInArrow(_coded(shared, packed), f"id {named.schema['id'].dataType.simpleString()}, ids {kind}, decoded binary")
    return coded.withColumnRenamed("id", id_col)

"""Packing documents into fixed-length training sequences by linear grouping.

1. Every text is tokenised once, where it is; pieces of at most ``capacity`` tokens result.
2. The lengths' histogram (at most ``capacity`` numbers, whatever the input) is all the driver sees.
   Large lengths are dealt into groups of equal cardinality and rounded up to their group's largest;
   a column-generation linear program finds the best mix of configurations of those few sizes. The
   actual lengths then take the rounded slots, and what is left over, large or small, is placed by best
   fit in order of falling length. The plan stays a histogram: runs of sequences that look alike.
3. Each piece gets its rank among the pieces of its length (by offsets of sub-groups, so that no length
   is numbered in one task) and looks its place up in the broadcast plan.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._shared import durable, plain_text
from lectern.llm._tokens import small

CAPACITY = 4096
END_ID = 1
#: Lengths over this part of the capacity are large, and dealt into so many groups. The plan that needs
#: the fewest sequences is used.
SETTINGS = ((1 / 5, 6), (1 / 5, 10), (1 / 3, 6), (1 / 3, 10), (1 / 5, 14), (1 / 3, 14))
#: Words remembered in a worker: so many that were met once, and so many that came again.
CACHED_WORDS = 150_000
PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    """The library's tokenizer, with its own defaults: a special token's string in a text is that token."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Marks that may follow a word of letters; they are tokens of their own.
MARKS = b".,!?;:#$%&*|<>()[]{}\"/\\+=~^_@-"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write each byte as: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordMemory:
    """Ids of words. The tokenizer drops white space and never joins across it, so a word is encoded by itself.

    A word of Latin letters, lower-cased, is one piece of the tokenizer's cutting, and the marks after it
    are others: such words go to the merges directly. All other words go through the whole tokenizer.
    Words that come again are kept apart from those met once, so that the many rare ones don't drive them
    out; either part is emptied when it is full.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS):
        self.own, self.most = _tokenizer(path), most
        self.often: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        self.bodies: dict[str, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}

    def _whole(self, words: list[bytes]) -> list[bytes]:
        got = self.own.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in got]

    def _encoded(self, words: set[bytes]) -> dict[bytes, bytes]:
        out, whole = {}, []
        if len(self.bodies) > self.most:
            self.bodies.clear()
        for word in words:
            body = word.rstrip(MARKS)
            if body.isalpha():
                letters = body.lower().decode()
            else:
                letters = body.decode("utf-8", "replace").lower()
                if not letters.isalpha() or max(letters) >= "\u0250" or not unicodedata.is_normalized("NFC", letters):
                    whole.append(word)
                    continue
                letters = letters.encode().decode("latin-1").translate(_LETTERS)
            ids = self.bodies.get(letters)
            if ids is None:
                ids = self.bodies[letters] = np.array([x.id for x in self.own.model.tokenize(letters)], "<u4").tobytes()
            tail = word[len(body) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {b"": b""}
                self.tails[tail] = self._whole([tail])[0]
            out[word] = ids + self.tails[tail]
        out.update(zip(whole, self._whole(whole)))
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian 32-bit numbers."""
        split = [x.split() for x in texts]
        words = set().union(*split)
        new = words.difference(self.often)
        again = new.intersection(self.once)
        if len(self.often) + len(again) > self.most:
            self.often.clear()
            new, again = words, words.intersection(self.once)
        for word in again:
            self.often[word] = self.once.pop(word)
        fresh = self._encoded(new - again)
        if len(self.once) + len(fresh) > self.most:
            self.once.clear()
        self.once.update(fresh)
        often, once = self.often, self.once
        return [b"".join([often[w] if w in often else once[w] for w in ws]) for ws in split]


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordMemory(path)  # it goes with the partition
        for part in small(batches):
            out = []
            for doc, got in zip(part.column(0).to_pylist(), memory.ids(part.column(1).cast(pa.binary()).to_pylist())):
                got += end
                for k, a in enumerate(range(0, len(got), 4 * capacity)):
                    own = got[a : a + 4 * capacity]
                    out.append((doc, k, a // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else b""))
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], part.column(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``id``, ``piece`` (from 0), ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    schema = PIECES.format(id=named.schema["id"].dataType.simpleString()) + (", ids array<int>" if keep_ids else "")
    return named.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), schema)


# --- the plan, over the histogram of lengths ---------------------------------------------------


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most, and its worth."""
    most = int(capacity // sizes.min())
    best = [np.zeros(capacity + 1)]
    took = []
    for _ in range(most):
        last = best[-1]
        now, choice = last.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            better = last[: capacity + 1 - s] + worth[i] > now[s:] + 1e-12
            now[s:][better] = last[: capacity + 1 - s][better] + worth[i]
            choice[s:][better] = i
        best.append(now)
        took.append(choice)
    counts = np.zeros(len(sizes), np.int64)
    room = capacity
    for choice in reversed(took):
        if (i := choice[room]) >= 0:
            counts[i] += 1
            room -= sizes[i]
    return float(best[-1][capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[float, np.ndarray]]:
    """How often to use which configuration: the linear program over few sizes, by column generation."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        use = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = best_configuration(sizes, worth, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, demand)
    return [(u, basis[:, k].astype(np.int64)) for k, u in enumerate(use) if u > 1e-9]


class Runs:
    """Runs of sequences with equal contents: [count, items], item = (length, first rank, copies)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list] = {}
        self.mask = 0  # bit r: a run with room r exists
        self.ranks: dict[int, int] = {}

    def take(self, length: int, n: int) -> int:
        first = self.ranks.get(length, 0)
        self.ranks[length] = first + n
        return first

    def add(self, count: int, items: list, room: int) -> None:
        if count:
            self.by_room.setdefault(room, []).append((count, items))
            self.mask |= 1 << room

    def best_fit(self, length: int, n: int) -> None:
        """Places ``n`` pieces of one length, each where the least room is left over."""
        while n:
            fits = self.mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                count, items = self.by_room[room].pop()
                if not self.by_room[room]:
                    self.mask &= ~(1 << room)
            else:
                room, items = self.capacity, []
                count = -(-n // (room // length))
            copies = room // length
            full = min(count, n // copies)
            if full:
                self.add(full, [*items, (length, self.take(length, full * copies), copies)], room - copies * length)
                n -= full * copies
            rest = count - full
            if rest and n:
                some = min(n, copies)
                after = shifted(items, full)
                self.add(1, [*after, (length, self.take(length, some), some)], room - some * length)
                n -= some
                self.add(rest - 1, shifted(items, full + 1), room)
            else:
                self.add(rest, shifted(items, full), room)


def shifted(items: list, by: int) -> list:
    """The items of a run from its ``by``-th sequence on."""
    return [(length, first + by * copies, copies) for length, first, copies in items]


def plan_for(histogram: dict[int, int], capacity: int, large_part: float, groups: int) -> Runs:
    out = Runs(capacity)
    left = dict(histogram)
    large = sorted((x for x in left if capacity * large_part < x < capacity), reverse=True)
    total = sum(left[x] for x in large)
    if large:
        # groups of equal cardinality, each rounded up to its largest length
        members: dict[int, list[list[int]]] = {}
        each, size, room = -(-total // groups), 0, 0
        for x in large:
            n = left[x]
            while n:
                if not room:
                    size, room = x, each
                some = min(n, room)
                members.setdefault(size, []).append([x, some])
                n, room = n - some, room - some
        sizes = np.array(sorted(members, reverse=True), np.int64)
        demand = np.array([sum(n for _, n in members[int(s)]) for s in sizes], float)
        for use, counts in configurations(sizes, demand, capacity):
            count = int(use + 1e-6)
            slots = [int(sizes[i]) for i in np.flatnonzero(counts) for _ in range(counts[i])]
            if not slots or min(sum(n for _, n in members[s]) // slots.count(s) for s in slots) < count:
                count = min((sum(n for _, n in members[s]) // slots.count(s) for s in slots), default=0)
            # the actual lengths take the slots, largest first; a run ends where one of them changes
            while count:
                now: list[list[int]] = []
                taken: dict[int, int] = {}
                for s in slots:
                    queue = members[s]
                    k = taken.get(s, 0)
                    while queue[k][1] == 0:
                        k += 1
                    now.append(queue[k])
                    taken[s] = k
                same: dict[int, int] = {}
                for entry in now:
                    same[id(entry)] = same.get(id(entry), 0) + 1
                short = next((e for e in now if e[1] < same[id(e)]), None)
                if short is not None:  # one sequence takes the last of this length and the first of the next
                    mixed: list[int] = []
                    for s in slots:
                        entry = next(e for e in members[s] if e[1])
                        entry[1] -= 1
                        mixed.append(entry[0])
                    many, used = 1, mixed
                else:
                    many = min(count, *(e[1] // same[id(e)] for e in now))
                    used = [e[0] for e in now]
                    for e in now:
                        e[1] -= many
                items = []
                for x in used:
                    items.append((x, out.take(x, many), 1))
                    left[x] -= many
                out.add(many, items, capacity - sum(used))
                count -= many
    for x in sorted(left, reverse=True):
        if left[x]:
            out.best_fit(x, left[x])
    return out


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places for all pieces: length, first and last rank, copies a sequence, first sequence, offset."""
    best = None
    for large_part, groups in SETTINGS:
        tried = plan_for(histogram, capacity, large_part, groups)
        n = sum(count for runs in tried.by_room.values() for count, _ in runs)
        if best is None or n < best[0]:
            best = (n, tried)
    rows, sequence = [], 0
    for runs in best[1].by_room.values():
        for count, items in runs:
            at = 0
            for length, first, copies in items:
                rows.append((length, first, first + count * copies, copies, sequence, at))
                at += length * copies
            sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "end", "copies", "sequence", "at"]).astype("int64")


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length; a length's pieces are numbered in many tasks."""
    salts = 64 + pieces.count() // 2_000_000
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece")
    numbered = salted.withColumn("row", F.row_number().over(inside) - 1)
    return numbered.join(offsets.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("row")).drop("salt", "row", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have ``id``, ``piece`` and ``length``."""
    spark = pieces.sparkSession
    pieces = durable(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = spark.createDataFrame(packing_plan(histogram, capacity))
    places = plan.groupBy("length").agg(F.collect_list(F.struct("first", "end", "copies", "sequence", "at")).alias("runs"))
    found = ranked_by_length(pieces).join(F.broadcast(places), "length")
    found = found.withColumn("run", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["end"])), 1))
    nth = F.col("rank") - F.col("run.first")
    return found.select(
        *pieces.columns,
        (F.col("run.sequence") + F.floor(nth / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod(nth, F.col("run.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenises and packs every document: one row per piece, with its place.

    A document is its text's ids and one ``end_id``; a null or empty text is that id alone. Documents
    longer than ``capacity`` are cut at its multiples, others never. Rows that repeat an id are packed
    as documents of their own. An empty table gives an empty result. Columns other than the two named
    ones are not read.
    """
    pieces = tokenised_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)
    return pack(pieces, capacity).withColumnRenamed("id", id_col)

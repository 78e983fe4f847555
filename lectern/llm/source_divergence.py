"""How the sources of a language differ in vocabulary, by a two-pass vocabulary automaton.

The first pass counts exactly in how many documents of its language each term occurs; terms of enough
documents are kept. The second pass runs an Aho-Corasick automaton over the kept terms, each padded with
a delimiter, along the texts, whose characters that belong to no term have become delimiters: so every
match is a whole term. Both passes count within the task before anything shuffles. What comes out are
sparse postings (language, term: the sources that have it); pairs of sources and the ranks of terms are
worked out from the postings alone, as all that lacks in a source has one and the same share there.

The kept terms reach the tasks in blocks of about ``BLOCK`` bytes, one automaton a block and language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm._shared import durable, plain_text
from lectern.llm._tokens import small

#: Bytes of kept terms an automaton holds; counted keys and bytes of text after which a task hands on what it has counted; pairs that it adds up at a time.
BLOCK, KEYS, HELD, PAIRS = 4 << 20, 300_000, 64 << 20, 1 << 20
#: Terms of more bytes go by their digest in the automaton.
LONGEST = 256
SALTS, SCALE = 32, 1_000_000_000
#: ASCII but letters is a delimiter, and capitals become small; the bytes of other characters stay.
_PADDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def padded(text: str) -> bytes:
    """The text in lower case, with spaces for all that belongs to no term."""
    return text.encode().translate(_PADDED)


def _short(term: bytes) -> bytes:
    """A term as the automaton has it: a long one as its digest behind a digit, which no term has, so that the automaton stays flat."""
    return term if len(term) <= LONGEST else b"0" + hashlib.sha256(term).hexdigest().encode()


def _shortened(data: bytes) -> bytes:
    """Padded text with its long terms as their digests."""
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if np.diff(gaps, prepend=-1, append=len(data)).max() <= LONGEST + 1:
        return data
    return b" ".join(map(_short, data.split(b" ")))


def _slices(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Consecutive parts that end at a delimiter."""
    at = 0
    while at < len(data):
        to = data.find(b" ", at + size) if at + size < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to]
        at = to


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of the task's documents a term occurs."""
    counts: dict[str, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            terms = list(own)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), _strings(part), pa.array([own[t] for t in part], pa.int64())], ["lang", "term", "n"])
        counts.clear()

    for part in small(batches):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            data = padded(text)
            held += len(data)
            counts.setdefault(lang, Counter()).update(set().union(*(x.split() for x in _slices(data))))
        if held > HELD or sum(map(len, counts.values())) > KEYS:
            yield from flush()
            held = 0
    yield from flush()


class Block:
    """Kept terms of languages; the automata are built once a process."""

    def __init__(self, terms: dict[str, list[str]]):
        self.terms, self._automata = terms, {}

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_automata": {}}

    def automaton(self, lang: str):
        if lang not in self._automata:
            import ahocorasick

            own = ahocorasick.Automaton()
            for k, term in enumerate(self.terms[lang]):
                own.add_word(f" {_short(term.encode()).decode()} ", k)
            own.make_automaton()
            self._automata[lang] = own
        return self._automata[lang]


def _recounted(block):
    """(lang, source, term, n): how often the block's terms occur in the task's documents of a language and source."""

    def recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value.terms
        counts: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                numbers = list(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(numbers), pa.string()), pa.array([source] * len(numbers), pa.string()), pa.array([terms[lang][k] for k in numbers], pa.string()), pa.array([own[k] for k in numbers], pa.int64())],
                    ["lang", "source", "term", "n"],
                )
            counts.clear()

        for part in small(batches):
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                if lang in terms:
                    texts.setdefault((lang, source), []).append(padded(text))
            for group, own in texts.items():
                found = counts.setdefault(group, Counter())
                automaton = block.value.automaton(group[0])
                for x in _slices(b" ".join(own)):
                    found.update(map(itemgetter(1), automaton.iter(f" {_shortened(x).decode()} ")))
            if sum(map(len, counts.values())) > KEYS:
                yield from flush()
        yield from flush()

    return recounted


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, n): the terms in at least ``least`` documents of a language. Needs lang and text without nulls."""
    parts = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms by language and source; none that doesn't occur."""
    spark = docs.sparkSession
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    counted = None
    for b in range(blocks):
        own: dict[str, list[str]] = {}
        for r in terms.where(F.expr(f"pmod(xxhash64(term), {blocks}) = {b}")).select("lang", "term").toLocalIterator():
            own.setdefault(r.lang, []).append(r.term)
        part = docs.select("lang", "source", "text").mapInArrow(_recounted(spark.sparkContext.broadcast(Block(own))), "lang string, source string, term string, n long")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        counted = spark.createDataFrame([], "lang string, source string, term string, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; 1 where nothing is kept."""
    count = F.col(count) if isinstance(count, str) else count
    whole = lambda c: c.cast("decimal(20,0)")
    value = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + 5), whole(F.col(total)) + 5 * whole(F.col(kept)))
    return F.when(F.col(kept) > 0, 1 + value).otherwise(F.lit(1)).cast("long")


def _salted(rows: DataFrame, by: Column, facts: DataFrame, keys: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join with facts of few keys, which may have any part of the rows: each key is dealt over ``salts`` of them."""
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread, [*keys, "salt"]).drop("salt")


def _shared_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): what terms that both sources have change, added up over the task's postings.

    Absent terms have the share z of their source; that they all have it is counted in elsewhere, so a term of
    both adds |p - q| - |p - z of q| - |z of p - q| + |z of p - z of q|.
    """
    names: list[tuple[str, str]] = []
    numbers: dict[tuple[str, str], int] = {}
    codes: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def reduced() -> None:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, at, np.concatenate(values))
        codes[:], values[:] = [code], [total]

    def flush() -> Iterator[pa.RecordBatch]:
        if codes:
            reduced()
            left, right = np.divmod(codes[0], 1 << 31)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k][0] for k in left], pa.string()), pa.array([names[k][1] for k in left], pa.string()), pa.array([names[k][1] for k in right], pa.string()), pa.array(values[0])],
                ["lang", "source", "item", "value"],
            )
            codes.clear()
            values.clear()

    for batch in batches:
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        entries = lists.flatten()
        owners = np.repeat(np.arange(len(sizes)), sizes)
        langs = batch.column(0).to_pylist()
        who = np.empty(len(entries), np.int64)
        for k, group in enumerate(zip(map(langs.__getitem__, owners.tolist()), entries.field("source").to_pylist())):
            if group not in numbers:
                numbers[group] = len(names)
                names.append(group)
            who[k] = numbers[group]
        p, z = entries.field("p").to_numpy(), entries.field("z").to_numpy()
        # of each entry the entries of the same term: as many rows at a time as make PAIRS pairs
        starts = np.cumsum(sizes) - sizes
        partners = np.repeat(sizes, sizes)
        cut = np.searchsorted(np.cumsum(partners), np.arange(PAIRS, partners.sum() + PAIRS, PAIRS), side="right")
        at = 0
        for to in cut.tolist():
            to = min(max(to, at + 1), len(partners)) if at < len(partners) else at
            if to > at:
                n = partners[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[owners[at:to]], n)
                i, j = i[i != j], j[i != j]
                codes.append(who[i] << 31 | who[j])
                values.append(abs(p[i] - p[j]) - abs(p[i] - z[j]) - abs(z[i] - p[j]) + abs(z[i] - z[j]))
                at = to
            if sum(map(len, codes)) > 4 * PAIRS:
                reduced()
                if len(codes[0]) > 2 * PAIRS:
                    yield from flush()
        assert at == len(partners)
    yield from flush()


def audit_sources(docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far a source is from the others of its language, and by which terms.

    A term is a run of letters a-z and of characters beyond ASCII, in lower case as far as A-Z goes. A
    language keeps the terms in at least ``least`` of its documents. The share of a kept term in a group is
    1 + floor(10^9 (count + 5) / (N + 5 V)), with N the occurrences of all V kept terms. Part ``pair``
    ranks the language's other sources by the summed differences of shares; part ``term`` ranks, to
    ``top``, the terms that the source has and whose share exceeds that in the whole language, by the excess. Ties go by
    the item's bytes.

    Null texts, languages and sources count as empty ones; documents without terms still make a group.
    Repeated rows count as often as they come; ids are not read, nor any other column. Without kept terms
    pairs have the value 0. An empty table gives an empty result.
    """
    named = docs.select(plain_text(F.col(lang_col)).alias("lang"), plain_text(F.col(source_col)).alias("source"), plain_text(F.col(text_col)).alias("text"))
    terms = durable(kept_terms(named, least), "kept-terms")
    found = durable(occurrences(named, terms), "occurrences")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.groupBy("lang", "source").agg(F.lit(0).alias("total")).unionByName(totals).groupBy("lang", "source").agg(F.sum("total").cast("long").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole")).join(kept, "lang", "left").fillna(0, ["kept"])
    groups = durable(groups.join(whole, "lang").withColumn("z", share(F.lit(0), "total", "kept")), "groups", after=(terms,))

    shares = _salted(found, F.col("term"), groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    by_term = shares.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "p", "z")).alias("entries"), F.sum("n").alias("n"), F.first("whole").alias("whole"), F.first("kept").alias("kept")
    )
    postings = durable(by_term.select("lang", "term", share("n", "whole", "kept").alias("q"), "entries"), "postings", after=(found,))
    single = postings.select("lang", "term", "q", F.inline("entries"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = single.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # of a pair: all terms as if absent from both, then what each one's own terms change, then what common terms change
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    gap = F.abs(F.col("z") - F.col("other_z"))
    pairs = _salted(groups, F.col("source"), other, ["lang"]).where(F.col("source") != F.col("item")).select("lang", "source", "item", (F.col("kept") * gap).alias("value"))
    alike = single.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("n"))
    own = _salted(alike, F.col("p"), other, ["lang"]).where(F.col("source") != F.col("item"))
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("other_z")) - gap)).alias("value"))
    both = postings.select("lang", "entries").mapInArrow(_shared_parts, T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "item")] + [T.StructField("value", T.LongType())]))
    swapped = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = pairs.unionByName(own).unionByName(swapped).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")

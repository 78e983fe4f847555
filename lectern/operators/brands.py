"""Brand names in tender texts, clause by clause, with whether the clause lets an equivalent in.

A table of names of bounded size becomes an Aho-Corasick automaton that is broadcast; a larger one is joined
with the texts' runs of words. Both find the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of names that an automaton may hold, and of the longest one, as its depth is that of the automaton.
BOUND, LONGEST = 4 << 20, 1000
#: Words of a name that a join looks for, at most.
MOST_WORDS = 16
#: What parts clauses, and what lets another product in.
CLAUSE, EQUIVALENT = r"[.;\n]+", r"\bor (an )?(approved )?(equivalent|equal)\b"


def clauses(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clause_no, clause, equivalent) of whole texts, in ASCII lower case: no name, and no exemption, goes across a clause."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = documents.select(F.col(key).alias("key"), F.posexplode(F.split(lower, CLAUSE)).alias("clause_no", "clause"))
    return cut.select("key", "clause_no", "clause", F.col("clause").rlike(EQUIVALENT).alias("equivalent"))


def _names(brands: DataFrame, name: str) -> DataFrame:
    """(brand, n_words): names as they are looked for, in lower case and with single spaces between words."""
    lower = F.trim(F.regexp_replace(F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"\s+", " "))
    return brands.select(lower.alias("brand")).where("brand <> ''").distinct().withColumn("n_words", F.size(F.split("brand", " ")))


def _words(clause: Column) -> Column:
    """Words without the commas, brackets and quotes around them."""
    return F.filter(F.transform(F.split(clause, r"\s+"), lambda w: F.regexp_replace(w, r"""^[,:()\[\]"'!?]+|[,:()\[\]"'!?]+$""", "")), lambda w: w != "")


class _Finder:
    """An automaton over names padded with spaces; it is built once a process."""

    def __init__(self, names: list[str]):
        self.names, self._automaton = names, None

    def __getstate__(self) -> dict:
        return {"names": self.names, "_automaton": None}

    def counts(self, padded: str) -> dict[str, int]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for name in self.names:
                self._automaton.add_word(f" {name} ", name)
            self._automaton.make_automaton()
        found: dict[str, int] = {}
        for _, name in self._automaton.iter(padded):
            found[name] = found.get(name, 0) + 1
        return found


def _by_automaton(rows: DataFrame, names: list[str]) -> DataFrame:
    finder = rows.sparkSession.sparkContext.broadcast(_Finder(names))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = pa.Table.from_batches([batch]).drop_columns("padded")
            hits = [(i, brand, n) for i, words in enumerate(batch.column("padded").to_pylist()) for brand, n in finder.value.counts(words).items()]
            at, brand, n = zip(*hits) if hits else ((), (), ())
            found = rest.take(pa.array(at, pa.int64())).append_column("brand", pa.array(brand, pa.string())).append_column("n", pa.array(n, pa.int64()))
            yield from found.to_batches()

    padded = rows.withColumn("padded", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).drop("words")
    return padded.mapInArrow(search, StructType([*padded.drop("padded").schema.fields, StructField("brand", StringType()), StructField("n", LongType())]))


def _by_join(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Runs of as many words as some name has, joined with the names; equal runs of a clause are counted before the join."""
    lengths = [r.n_words for r in names.select("n_words").distinct().collect()]  # MOST_WORDS at most, unless that is an error
    if max(lengths) > MOST_WORDS:
        raise ValueError(f"a name of more than {MOST_WORDS} words")

    def runs(n: int) -> Column:
        """Each word with those behind it: the array beside itself, shifted."""
        side_by_side = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"w{k}") for k in range(n)])
        whole = F.filter(side_by_side, lambda z: z[f"w{n - 1}"].isNotNull())
        return F.transform(whole, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(n)]))

    each = rows.withColumn("brand", F.explode(F.concat(*map(runs, lengths)))).drop("words")
    counted = each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(names.select("brand"), "brand", "left_semi")


def brand_mentions(documents: DataFrame, brands: DataFrame, key: str, text: str, name: str, bound: int = BOUND) -> DataFrame:
    """(key, clause_no, brand, n, equivalent): the names that each clause of a text mentions, and how often.

    Names are found as whole words, whatever their case (A-Z) and the white space and the commas, brackets or quotes
    between words; longer names don't hide shorter ones within them. ``equivalent``: the clause says "or
    equivalent", "or equal" or the like. Names of ``bound`` bytes together and ``LONGEST`` each at most are
    broadcast as an automaton, others are joined; there, names of more than ``MOST_WORDS`` words are an error. Null texts and names give nothing; equal rows are counted apart by the
    automaton and together by the join, so keys are unique.
    """
    names = _names(brands, name)
    size, longest = names.agg(F.sum(F.octet_length("brand") + 8), F.max(F.octet_length("brand"))).first()
    # by way of an array of one, so that the words are made once and not again wherever they are used
    rows = clauses(documents, key, text).select("key", "clause_no", "equivalent", F.explode(F.array(_words(F.col("clause")))).alias("words")).where(F.size("words") > 0)
    if not size:
        found = rows.where(F.lit(False)).select("key", "clause_no", "equivalent", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("long").alias("n"))
    elif size <= bound and longest <= LONGEST:
        found = _by_automaton(rows, [r.brand for r in names.collect()])
    else:
        found = _by_join(rows, names)
    return found.select(F.col("key").alias(key), "clause_no", "brand", "n", "equivalent")


def restrictive(mentions: DataFrame, key: str) -> DataFrame:
    """(key, n_brands, n_restrictive, severity): per text the brands named, and those in a clause that lets no equivalent in."""
    named = F.countDistinct("brand").alias("n_brands")
    closed = F.countDistinct(F.when(~F.col("equivalent"), F.col("brand"))).alias("n_restrictive")
    return mentions.groupBy(key).agg(named, closed).withColumn("severity", F.when(F.col("n_restrictive") > 0, "high").otherwise("low"))

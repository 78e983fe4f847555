"""Near-duplicate lines by a deletion-neighbourhood join.

The unit is the word and the bound one edit in ``WORDS_AN_EDIT`` words: one word put in, taken out or
changed, if the longer line has so many words or more. Shorter lines are near to none; only exact copies of
them count. Every line names its deletion variants - itself, and itself without its i-th word for every i -
as hashed keys. Two lines are within one edit exactly if

* one is a variant of the other without its i-th word (a word was put in or taken out), or
* both have the same variant at the same i (a word was changed).

So a key needs no pairs: of the lines that share (variant, i) all are one edit apart, and of those that
share a variant the one that *is* the variant is one edit from all others. The earliest line of each
such bucket is a grouped minimum, and a line's earliest neighbour is the least of its buckets'.

Equal lines are one before any of this. A first, cheap pass keeps the neighbourhoods small: a line whose
first and last half (of either rounding) no other line shares cannot be one edit from any, as an edit
leaves one half as it is; it emits no variants. Variants' hashes are prefix sums over exploded words, so
a line of any length costs in proportion to its words. The neighbours found are verified word by word.

Bitmaps of bounded size let the rows that can't meet any other stay where they are: halves that stand
alone, lines that aren't candidates, and at last the lines that are neither copies nor near.

Built from DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._shared import SPACES, bitmap, durable, join_facts, maybe_in, plain_text

WORDS_AN_EDIT = 5
# A sequence's hash is sum(hash(word) * B**place) modulo a prime, twice. The products stay below 2**62.
PRIMES = (2147483629, 2147483587)
BASES = (1000003, 998244353)
#: Places are below 2**PLACE_BITS; powers of the bases come from a place's digits.
PLACE_BITS, DIGIT = 31, 7
HALVES = ("first_n", "first_less", "last_n", "last_less")


def _power(k: int, place: Column) -> Column:
    """BASES[k] ** place modulo PRIMES[k], from tables of the place's digits of ``DIGIT`` bits."""
    p, out = PRIMES[k], None
    for low in range(0, PLACE_BITS, DIGIT):
        table = F.array(*[F.lit(pow(BASES[k], d << low, p)).cast("long") for d in range(1 << min(DIGIT, PLACE_BITS - low))])
        digit = F.get(table, F.shiftright(place, low).bitwiseAND(F.lit((1 << DIGIT) - 1)))
        # most lines are short: the upper digits are 0
        out = digit if out is None else F.when(place < (1 << low), out).otherwise(F.pmod(out * digit, F.lit(p)))
    return out


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 0, line)."""
    split = F.split(plain_text(F.col(text_col)), "\n", -1)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(split).alias("line_no", "line"))


def _words_of(line: str) -> Column:
    return F.filter(F.split(F.lower(line), SPACES, -1), lambda w: w != "").alias("words")


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 0, words) of every line; words are lower-cased, a blank line has none."""
    return _raw_lines(docs, id_col, text_col).select("id", "line_no", _words_of("line"))


def _places(lines: DataFrame) -> DataFrame:
    """(id, line_no, n, k1, k2, HALVES): two hashes of the words, and those of first and last halves.

    Halves are taken for n and for n - 1 words, so that a line and one with a word more share one; lines
    that are too short to be near any have none.
    """
    half = lambda side, n, of: F.expr(f"if(n >= {WORDS_AN_EDIT - 1}, xxhash64('{side}', {n}, {of}), null)")
    halves = (
        half("F", "n div 2", "slice(words, 1, n div 2)"),
        half("F", "(n - 1) div 2", "slice(words, 1, (n - 1) div 2)"),
        half("L", "n - n div 2", "slice(words, n div 2 + 1, n)"),
        half("L", "n - 1 - (n - 1) div 2", "slice(words, n - (n - 1 - (n - 1) div 2) + 1, n)"),
    )
    sized = lines.withColumn("n", F.size("words"))
    own = [F.when(F.col("n") > 0, F.xxhash64(F.lit(seed), "words")).alias(f"k{seed}") for seed in (1, 2)]
    return sized.select("id", "line_no", "n", *own, *[h.alias(name) for h, name in zip(halves, HALVES)])


def _candidates(distinct: DataFrame) -> DataFrame:
    """(k1, k2, at) of the distinct lines that share a half with another one."""
    halves = F.explode(F.array_distinct(F.array(*HALVES)))
    parts = distinct.where(F.col(HALVES[0]).isNotNull()).select("k1", "k2", "at", halves.alias("half"))
    shared = durable(parts.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"), "line-halves")
    some = maybe_in(parts, "half", bitmap(shared, "half")).where("maybe").drop("maybe")
    return durable(some.join(shared, "half", "left_semi").groupBy("k1", "k2").agg(F.min("at").alias("at")), "line-candidates", after=(shared,))


def _variants(words: DataFrame) -> DataFrame:
    """(h, i, k1, at): the hashed deletion variants of lines (k1, k2, at, words); i = -1: the line itself.

    A line that is too short to be the longer of two near ones has only itself.
    """
    each = words.select("k1", "k2", "at", F.posexplode("words").alias("i", "word"))
    line = Window.partitionBy("k1", "k2")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k, p in enumerate(PRIMES):
        each = each.withColumn(f"t{k}", F.pmod(F.pmod(F.xxhash64(F.lit(k), "word"), F.lit(p)) * _power(k, F.col("i")), F.lit(p)))
    summed = each.select(
        "k1", "at", "i", F.count(F.lit(1)).over(whole).alias("n"), *[f"t{k}" for k in range(2)],
        *[F.sum(f"t{k}").over(upto).alias(f"upto{k}") for k in range(2)], *[F.sum(f"t{k}").over(whole).alias(f"all{k}") for k in range(2)],
    )

    def joined(a: Column, b: Column, n: Column) -> Column:
        return F.xxhash64(a, b, n)

    # without the i-th word the later ones move down a place
    less = [
        F.pmod(F.pmod(F.col(f"upto{k}") - F.col(f"t{k}"), F.lit(p)) + F.pmod(F.pmod(F.col(f"all{k}") - F.col(f"upto{k}"), F.lit(p)) * F.lit(pow(BASES[k], -1, p)), F.lit(p)), F.lit(p))
        for k, p in enumerate(PRIMES)
    ]
    total = [F.pmod(F.col(f"all{k}"), F.lit(p)) for k, p in enumerate(PRIMES)]
    shorter = F.struct(joined(*less, F.col("n") - 1).alias("h"), F.col("i").alias("i"))
    itself = F.struct(joined(*total, F.col("n")).alias("h"), F.lit(-1).alias("i"))
    long = F.col("n") >= WORDS_AN_EDIT
    both = F.array_compact(F.array(F.when(long, shorter), F.when(F.col("i") == 0, itself)))
    return summed.select("k1", "at", F.explode(both).alias("v")).select("v.h", "v.i", "k1", "at")


def within_one_edit(a: str, b: str) -> Column:
    """Whether two arrays of words are one word apart at most."""
    first = f"(array_position(zip_with({a}, {b}, (x, y) -> not (x <=> y)), true))"  # of the words that differ, from 1; 0: none
    rest = lambda w, skip: f"slice({w}, cast({first} as int) + {skip}, size({w}) + 1)"
    return F.expr(
        f"""{first} = 0
        or (size({a}) = size({b}) and {rest(a, 1)} = {rest(b, 1)})
        or (size({a}) = size({b}) + 1 and {rest(a, 1)} = {rest(b, 0)})
        or (size({a}) + 1 = size({b}) and {rest(a, 0)} = {rest(b, 1)})"""
    )


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, near): distinct lines and the earliest place of another line within one edit, if it is earlier."""
    wanted = _candidates(distinct)
    places = wanted.select("k1", "k2", "at", F.col("at.id").alias("id"), F.col("at.line_no").alias("line_no"))
    # a line's words are read again where it stands first, and only there
    lines = _raw_lines(docs, id_col, text_col).withColumn("place", F.xxhash64("id", "line_no"))
    some = maybe_in(lines, "place", bitmap(wanted.select(F.xxhash64("at.id", "at.line_no").alias("place")), "place")).where("maybe")
    found = some.select("id", "line_no", _words_of("line")).join(places, ["id", "line_no"]).select("k1", "k2", "at", "words")
    # an id that stands on several rows has several lines at a place
    same = (F.xxhash64(F.lit(1), "words") == F.col("k1")) & (F.xxhash64(F.lit(2), "words") == F.col("k2"))
    words = durable(found.where(same).dropDuplicates(["k1", "k2"]), "line-words", after=(wanted,))

    variants = durable(_variants(words), "line-variants")
    total = variants.count()
    # only variants that come more than once meet
    shared = durable(variants.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "line-shared")
    some = durable(maybe_in(variants, "h", bitmap(shared, "h")).where("maybe").drop("maybe"), "line-some", after=(variants, shared))
    edited = lambda what: F.min(F.when(what, F.col("at")))
    facts = some.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("k1").alias("a"), F.max("k1").alias("b"), edited(F.col("i") >= 0).alias("longer"), edited(F.col("i") < 0).alias("itself")
    )
    facts = durable(facts.where("a <> b").select("h", "n", "longer", "itself"), "line-buckets")
    met = durable(join_facts(some, facts, ["h"], total), "line-meets", after=(facts, some))
    less = met.where("i >= 0").select("h", "i", "at")
    changed = durable(less.groupBy("h", "i").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("near")).where("n > 1"), "line-changed")
    pairs = (
        met.select("at", F.when(F.col("i") < 0, F.col("longer")).otherwise(F.col("itself")).alias("near"))
        .union(join_facts(less, changed, ["h", "i"], total).select("at", "near"))
    )
    nearest = durable(pairs.where("near < at").groupBy("at").agg(F.min("near").alias("near")), "line-nearest", after=(met, changed))
    # one line may be the nearest of very many: it goes to each of their sub-groups
    dealt = nearest.withColumn("salt", F.pmod(F.xxhash64("at.id", "at.line_no"), F.lit(32)).cast("int"))
    theirs = dealt.select("near", "salt").distinct().join(words.select(F.col("at").alias("near"), F.col("words").alias("theirs")), "near")
    mine = words.select("at", "k1", "k2", F.col("words").alias("mine"))
    both = dealt.join(mine, "at").join(theirs, ["near", "salt"]).where(within_one_edit("mine", "theirs"))
    return durable(both.select("k1", "k2", "near"), "line-near", after=(nearest, words))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, ``line_no``, ``n_words``, ``verdict`` and, unless it is kept, ``first`` (id, line_no).

    A line is a ``copy`` if the same words (lower-cased, split at ASCII white space) stand at an earlier
    place, else ``near`` if an earlier line is one word apart and the longer of the two has
    ``WORDS_AN_EDIT`` words or more, else ``kept``; places are ordered by id and line number. An earlier
    line counts even if it goes itself. Blank lines are always kept; a null or empty text is one blank
    line. Rows that repeat an id count as one document: their lines at equal numbers share a place. A null
    id is earlier than any other. An empty table gives an empty result. Other columns are not read.
    """
    places = durable(_places(lines_of(docs, id_col, text_col)), "line-places")
    worded = places.where("n > 0").withColumn("at", F.struct("id", "line_no"))
    # a line may be a third of all lines: a task sends one row of it
    distinct = worded.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), *[F.min(h).alias(h) for h in HALVES])
    distinct = durable(distinct, "line-distinct")
    near = near_lines(docs, distinct, id_col, text_col)
    facts = distinct.select("k1", "k2", "n", F.col("at").alias("first")).join(near, ["k1", "k2"], "left").where("n > 1 or near is not null")
    facts = durable(facts, "line-facts", after=(distinct, near))
    # lines that are neither copied nor near stay where they are
    flagged = maybe_in(worded.select("id", "line_no", F.col("n").alias("n_words"), "k1", "k2", "at"), "k1", bitmap(facts, "k1"))
    total = places.count()
    known = join_facts(flagged.where("maybe"), facts, ["k1", "k2"], total, "left")
    verdict = F.when(F.col("first") < F.col("at"), "copy").when(F.col("near").isNotNull(), "near").otherwise("kept")
    judged = known.select("id", "line_no", "n_words", verdict.alias("verdict"), F.when(F.col("first") < F.col("at"), F.col("first")).otherwise(F.col("near")).alias("first"))
    kept = lambda rows: rows.select("id", "line_no", "n_words", F.lit("kept").alias("verdict"), F.lit(None).cast(judged.schema["first"].dataType).alias("first"))
    blank = places.where("n = 0").select("id", "line_no", F.col("n").alias("n_words"))
    out = judged.unionByName(kept(flagged.where("not maybe"))).unionByName(kept(blank))
    return out.withColumnRenamed("id", id_col)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: ``n_lines`` (with words), ``n_copies``, ``n_near``, ``dropped`` (their numbers, sorted). Edge cases are as in :func:`line_verdicts`."""
    count = lambda what: F.sum(F.when(what, 1).otherwise(0)).cast("long")
    return line_verdicts(docs, id_col, text_col).groupBy(id_col).agg(
        count(F.col("n_words") > 0).alias("n_lines"),
        count(F.col("verdict") == "copy").alias("n_copies"),
        count(F.col("verdict") == "near").alias("n_near"),
        F.sort_array(F.collect_list(F.when(F.col("verdict") != "kept", F.col("line_no")))).alias("dropped"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, without the lines that are copies or near copies of earlier ones.

    Rows that repeat an id are documents of their own, ordered by a hash of their texts; rows that repeat
    both lose the same lines. Null texts stay null. Edge cases are else as in :func:`line_verdicts`.
    """
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), plain_text(F.col(text_col))).alias("text")).alias("row")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    packed = docs.select(own, row, F.col(text_col).alias("text"))
    gone = dropped_lines(packed.select("row", "text"), "row", "text").where(F.size("dropped") > 0).select(F.xxhash64("row").alias("hash"), F.col("row").alias("of"), "dropped")
    joined = packed.withColumn("hash", F.xxhash64("row")).join(gone, "hash", "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains("dropped", k)), "\n")
    text = F.when(F.col("dropped").isNull() | ~F.col("row").eqNullSafe(F.col("of")), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in docs.columns])

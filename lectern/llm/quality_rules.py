"""Quality rules whose cutoffs control the risk of rejecting good text.

Each rule compares one signal of a text with a cutoff. Candidate cutoffs run from lenient to strict and
are fixed beforehand. For each stratum (language) and rule they are tested in that order on a labelled
holdout, the good documents of the stratum: with k of n rejected, the exact binomial tail

    P(Bin(n, a) <= k)

is the p-value of "this cutoff rejects more than the share a of good documents". Testing goes on while
the p-value is at most delta / (strata * rules). All cutoffs that pass are safe together; of them the one
is used that best tells the stratum's labelled good from its bad (the most lenient of equals), and a rule
with none rejects nothing. Testing in a fixed order needs no correction within a rule, and the Bonferroni
division corrects for the strata and rules. Each rule gets an equal part a = alpha / rules, so that with
probability 1 - delta no stratum loses more than the share alpha of its good documents to all rules
together. Exact copies in the holdout are not independent; remove them first where that matters.

Built from DataFrame and SQL functions only. Texts are read once and never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import SPACES, durable, plain_text

MIN_WORDS, MAX_REPEATED = 50, 50
ALPHA, DELTA, STEPS = 0.1, 0.05, 24

#: Per rule the signal, the most lenient and the strictest cutoff. A text is rejected above the cutoff.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", 4000, 10),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", 1000, 30),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 1000, 50),
    "long_words": ("100 * word_chars div greatest(n_words, 1)", 2000, 620),
    "short_words": ("10000 * n_words div greatest(word_chars, 1)", 5000, 1700),
    "same_words": ("1000 - 1000 * n_distinct div greatest(n_words, 1)", 1000, 250),
}


def cutoffs(rule: str) -> list[int]:
    """The candidate cutoffs of a rule, from lenient to strict, in equal ratios."""
    _, lenient, strict = RULES[rule]
    return [round(lenient * (strict / lenient) ** (k / (STEPS - 1))) for k in range(STEPS)]


def _repeated(w: str) -> str:
    """How many of the words ``w`` stand in a window of three that occurs more than once.

    Windows' hashes are sorted with their places; equal neighbours repeat. Each repeated window adds the
    words that the one before it doesn't cover.
    """
    windows = f"transform(sequence(0, size({w}) - 3), i -> named_struct('h', xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), 'i', i))"
    again = "filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false))"
    places = f"sort_array(transform(element_at(transform(array(sort_array({windows})), s -> {again}), 1), x -> x.i))"
    step = "(a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p)"
    return f"if(size({w}) < 3, 0L, aggregate({places}, named_struct('n', 0L, 'last', -3), {step}, a -> a.n))"


def text_facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per input row: ``id``, ``stratum`` and the counts that rules use.

    A stratum is a language code of two letters, else "other", so there are at most 677.
    """
    stratum = F.lower(F.col(stratum_col)) if stratum_col in docs.columns else F.lit(None).cast("string")
    named = docs.select(F.col(id_col).alias("id"), F.when(stratum.rlike("^[a-z]{2}$"), stratum).otherwise("other").alias("stratum"), plain_text(F.col(text_col)).alias("text"))
    words = f"""array(filter(split(text, r"{SPACES}", -1), x -> x <> ''))"""
    of_words = F.expr(f"element_at(transform({words}, w -> named_struct('n', size(w), 'distinct', size(array_distinct(w)), 'again', {_repeated('w')})), 1)")
    lines = "array(filter(split(text, '\n', -1), x -> translate(x, ' \t\x0b\f\r', '') <> ''))"
    of_lines = F.expr(f"element_at(transform({lines}, l -> named_struct('n', size(l), 'distinct', size(array_distinct(l)))), 1)")
    without = lambda chars: F.length(F.translate("text", chars, ""))
    facts = named.select(
        "id", "stratum", of_words.alias("w"), of_lines.alias("l"),
        without(" \t\n\x0b\f\r").cast("long").alias("word_chars"),
        (F.length("text") - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length("text") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
    )
    return facts.select(
        "id", "stratum", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.col("l.n") - F.col("l.distinct")).cast("long").alias("n_dup_lines"),
        F.col("w.again").alias("n_repeat_words"), "n_capitals", F.col("l.n").cast("long").alias("n_lines"), F.col("w.distinct").cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _log_factorial(x: str) -> str:
    """Exact up to 20, then Stirling's series, whose error there is below 1e-13."""
    series = f"{x} * ln({x}) - {x} + 0.5D * ln(2 * pi() * {x}) + 1 / (12D * {x}) - 1 / (360D * {x} * {x} * {x}) + 1 / (1260D * pow({x}, 5))"
    return f"if({x} <= 20, ln(cast(factorial(cast(least({x}, 20L) as int)) as double)), {series})"


def binomial_tail(n: str, k: str, share: float) -> Column:
    """P(Bin(n, share) <= k), and 1 where k is at or beyond the mean.

    Terms are added from k downwards as long as they count; each is a ratio of the one before.
    """
    top = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({share}D) + ({n} - {k}) * ln({1 - share}D))"
    step = f"(a, i) -> named_struct('sum', a.sum + a.term, 'term', a.term * ({k} - i) / ({n} - {k} + i + 1) * {(1 - share) / share}D)"
    terms = f"aggregate(sequence(0L, least({k}, cast(40 * sqrt({n}) + 200 as long))), named_struct('sum', 0D, 'term', 1D), {step}, a -> a.sum)"
    return F.expr(f"if({k} >= {n} * {share}D, 1D, least(1D, {top} * {terms}))")


def controlled_cutoffs(facts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, rule, holdout, cutoff, false_rejections, p_value) of every rule that has a cutoff in a stratum.

    The holdout of a stratum is its documents labelled 1 that pass the base rules; of repeated labels of
    an id the largest counts. Strata without any are not tested.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("label"))
    holdout = facts.where(~base_failed()).join(own, F.col("id") == F.col("__id"))
    # the first candidate that rejects a document; all stricter ones do too
    first = lambda rule: F.expr(f"size(filter(array({', '.join(map(str, cutoffs(rule)))}), c -> c >= {RULES[rule][0]}))")
    each = holdout.select("stratum", "label", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), first(r).alias("at")) for r in RULES])).alias("x"))
    # one row per stratum, rule, candidate and label: a table of bounded size
    counts = durable(each.groupBy("stratum", "x.rule", "x.at", "label").agg(F.count(F.lit(1)).alias("docs")), "rule-counts")
    strata = counts.where("label = 1").select("stratum").distinct().count()
    totals = counts.groupBy("stratum", "rule").agg(
        F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("bad"),
        F.collect_list(F.struct("at", "label", "docs")).alias("by"),
    )
    rejected = lambda label: F.expr(f"aggregate(filter(by, b -> b.at <= step and b.label = {label}), 0L, (a, b) -> a + b.docs)")
    candidates = totals.where("n > 0").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))))
    tested = candidates.select("stratum", "rule", "n", "bad", "step", rejected(1).alias("k"), rejected(0).alias("b"))
    tested = tested.withColumn("p_value", binomial_tail("n", "k", alpha / len(RULES)))
    failed = F.col("p_value") > delta / (max(strata, 1) * len(RULES))
    # how far the shares rejected of bad and of good are apart
    tests = F.struct((F.col("b") * F.col("n") - F.col("k") * F.col("bad")).alias("apart"), (-F.col("step")).alias("lenient"), "step", "k", "p_value")
    run = tested.groupBy("stratum", "rule").agg(F.first("n").alias("holdout"), F.min(F.when(failed, F.col("step"))).alias("stop"), F.collect_list(tests).alias("tests"))
    best = run.withColumn("test", F.array_max(F.filter("tests", lambda t: F.col("stop").isNull() | (t["step"] < F.col("stop"))))).where("test is not null")
    cut = reduce(lambda c, r: c.when(F.col("rule") == r, F.element_at(F.array(*map(F.lit, cutoffs(r))), F.col("test.step") + 1)), RULES, F)
    return best.select("stratum", "rule", "holdout", cut.alias("cutoff"), F.col("test.k").alias("false_rejections"), "test.p_value")


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", stratum_col: str = "lang"
) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``kept``, ``stratum``, ``rejected_by`` (names of rules).

    A null or empty text has no words and fails the base rules. A null id is never labelled. A stratum
    with too few labels to guarantee anything rejects nothing beyond the base rules; nor does an empty
    table of labels. Rows that repeat an id are judged each on its own text. An empty table gives an empty
    result. Other columns are not read.
    """
    facts = durable(text_facts(docs, id_col, text_col, stratum_col), "rule-facts")
    found = controlled_cutoffs(facts, labels, alpha, delta, id_col, label_col)
    by_stratum = found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    by_stratum = durable(by_stratum, "rule-cutoffs")  # at most 677 rows
    judged = facts.join(F.broadcast(by_stratum), "stratum", "left")
    hits = F.array_compact(F.array(*[F.when(F.expr(RULES[r][0]) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    judged = judged.withColumn("base_failed", base_failed()).withColumn("rejected_by", hits)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "stratum", "rejected_by",
    )

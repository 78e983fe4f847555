"""Personal data: patterns, and information-theoretic sanitisation of the terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value found, as it is
written most plainly (an address in lower case, a number's digits), is a protected entity, and so is the
domain of an e-mail address. A term (a word) of a document that holds it discloses it in part: with p(.)
the share of different texts of the corpus,

    disclosure(term, entity) = log(p(entity | term) / p(entity)) / -log p(entity)

is the pointwise mutual information as a part of the entity's own information; it is 1 when the term
occurs only where the entity does. Most values stand in one document only, so nothing is asked to repeat;
instead the counts are smoothed by ``support`` texts that hold the term and the entity at its usual rate,

    p(entity | term) = (n(term, entity) + support * p(entity)) / (n(term) + support).

Secrets - long runs of letters and digits mixed, as keys and tokens are - are found and replaced too; they
say nothing of a person, so no terms are looked for around them.

Terms are generalised from ``generalise`` on and removed from ``remove`` on, in the documents that hold the
entity: of a value in one document, the rarest terms are generalised, and removed once more texts bear it
out or the corpus is large. Documents without personal data are never touched.

Built from DataFrame and SQL functions only. Texts are never shuffled; only documents with findings take
part in the co-occurrence, and the counts of the terms in question cover every document. A bitmap of
bounded size lets the words that are in question nowhere stay where they are. All other joins are merges:
Spark takes exploded words for as few rows as there are texts and would broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._shared import bitmap, durable, maybe_in, plain_text

# The four patterns, written so that a match never backtracks: runs are possessive and start where a run
# starts (or where the match before ended), which finds the same matches in linear time.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Keys and tokens: 20 letters and digits or more, with three of either at least.
SECRET = r"(?<![A-Za-z0-9])(?=(?:[A-Za-z]*+[0-9]){3})(?=(?:[0-9]*+[A-Za-z]){3})[A-Za-z0-9]{20,}+"
#: What a text must contain for a pattern to match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
KINDS = ("email", "ip", "card", "phone", "secret", "generalise", "remove")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "generalise": "[TERM]", "remove": ""}
SPAN = "array<struct<start:int,ord:int,kind:string,stop:int>>"
#: A term: a word of letters and digits.
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'-]*+"
SALTS = 32
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.85


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    digit = "cast(substring(d, length(d) - i, 1) as int)"
    total = f"aggregate(sequence(0, length(d) - 1), 0, (a, i) -> a + if(i % 2 = 0, {digit}, if({digit} > 4, {digit} * 2 - 9, {digit} * 2)))"
    return f"exists(array({_digits(x)}), d -> length(d) between 14 and 19 and {total} % 10 = 0)"


def _valid(kind: str, x: str) -> str:
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return f"length({_digits(x)}) between 10 and 15"
    return "true"


def _lit(pattern: str) -> str:
    return f'r"{pattern}"'


def matches(text: str, kind: str, pattern: str, need: str | None, ordinal: int, valid: str = "true", offset: str = "0") -> Column:
    """Spans of a pattern's matches in the column ``text``, in code points, from ``offset`` on.

    The pieces between matches and the matches themselves alternate; their lengths add up to positions.
    """
    parts = f"arrays_zip(split({text}, {_lit(pattern)}, -1), regexp_extract_all({text}, {_lit(pattern)}, 0))"
    step = f"""
      (a, x) -> if(x.`1` is null, a, named_struct(
        'pos', a.pos + length(x.`0`) + length(x.`1`),
        'out', if({valid.replace('$x', 'x.`1`')},
          concat(a.out, array(named_struct('start', a.pos + length(x.`0`), 'ord', {ordinal}, 'kind', '{kind}', 'stop', a.pos + length(x.`0`) + length(x.`1`)))),
          a.out)))"""
    found = f"aggregate({parts}, named_struct('pos', {offset}, 'out', cast(array() as {SPAN})), {step}).out"
    return F.expr(f"if(rlike({text}, {_lit(need)}), {found}, cast(array() as {SPAN}))" if need else found)


def base_spans(text: str = "text") -> Column:
    """All valid pattern matches, by start and then kind."""
    each = [matches(text, kind, PATTERNS[kind], NEEDS[kind], k, _valid(kind, "$x")) for k, kind in enumerate(KINDS[:4])]
    return F.sort_array(F.concat(*each))


def secret_spans(text: str = "text") -> Column:
    """Runs that look like keys or tokens and that no base span (column ``base``) overlaps."""
    found = matches(text, "secret", SECRET, "[A-Za-z0-9]{20}", KINDS.index("secret"))
    return F.filter(found, lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _terms(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lower)


def _entities(found: DataFrame) -> DataFrame:
    """(print, entity): the protected values of each text, as plainly written as can be, and the domains of addresses."""
    value = "lower(substring(text, m.start + 1, m.stop - m.start))"
    plain = f"case m.kind when 'email' then {value} when 'ip' then regexp_replace({value}, '(^|[.])0+(?=[0-9])', '$1') else {_digits(value)} end"
    each = found.select("print", "text", F.explode("base").alias("m")).select("print", F.col("m.kind").alias("kind"), F.expr(plain).alias("value"))
    keys = F.array(F.concat_ws(":", "kind", "value"), F.when(F.col("kind") == "email", F.concat(F.lit("domain:"), F.substring_index("value", "@", -1))))
    return each.select("print", F.explode(F.array_compact(keys)).alias("entity")).distinct()


def _classes(entities: DataFrame) -> DataFrame:
    """(print, class, with_entity): entities that stand in the same texts are one class, as all their counts are equal."""
    salted = entities.withColumn("salt", F.pmod("print", F.lit(SALTS)).cast("int"))
    # an entity may stand in a third of all texts: they are summed up in sub-groups first
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "print")).alias(f"x{seed}") for seed in (1, 2)]
    parts = salted.groupBy("entity", "salt").agg(F.count(F.lit(1)).alias("n"), *marks)
    facts = parts.groupBy("entity").agg(F.sum("n").alias("with_entity"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    per_salt = parts.select("entity", "salt").join(facts.select("entity", "with_entity", F.struct("with_entity", "x1", "x2").alias("class")).hint("merge"), "entity")
    return salted.join(per_salt.hint("merge"), ["entity", "salt"]).select("print", "class", "with_entity").distinct()


def _with_term(texts: DataFrame, prints: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, with_term): the number of different texts that hold each of ``terms``."""
    # copies count once: the terms of texts that may have any are told apart by text, those of others need not be
    held = maybe_in(texts, "print", bitmap(prints.where("n > 1"), "print"))
    words = held.select(F.when(F.col("maybe"), F.col("print")).alias("of"), F.explode(F.array_distinct(_terms("text"))).alias("term")).withColumn("hash", F.xxhash64("term"))
    asked = maybe_in(words, "hash", bitmap(terms.select(F.xxhash64("term").alias("hash")), "hash")).where("maybe")
    counts = asked.groupBy("term", "of").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("of").isNull(), F.col("n")).otherwise(1)).alias("with_term"))
    return counts.join(terms.hint("merge"), "term", "left_semi")


def disclosing_terms(held: DataFrame, texts: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(class, term, kind): terms that disclose a class of entities by at least ``generalise``; ``held``: (print, class, with_entity, term)."""
    prints = durable(texts.groupBy("print").agg(F.count(F.lit(1)).alias("n")), "pii-prints")
    total = float(max(prints.count(), 1))
    together = held.groupBy("class", "with_entity", "term").agg(F.count(F.lit(1)).alias("together"))
    terms = durable(held.select("term").distinct(), "pii-terms")
    counts = durable(_with_term(texts, prints, terms), "pii-counts", after=(prints, terms))
    scored = together.join(counts.hint("merge"), "term")
    entity = F.col("with_entity") / F.lit(total)
    information = -F.log(entity)
    given = (F.col("together") + F.lit(float(support)) * entity) / (F.col("with_term") + F.lit(float(support)))
    disclosure = F.when(information > 0, F.log(given / entity) / information).otherwise(F.lit(0.0))
    kind = F.when(disclosure >= remove, "remove").when(disclosure >= generalise, "generalise")
    return scored.select("class", "term", kind.alias("kind")).where("kind is not null")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    # copies have one fingerprint, whatever their ids
    return named.withColumn("row", _row(F.col("id"), F.col("text"))).withColumn("print", F.xxhash64(F.lower("text")))


def _row(own: Column, text: Column) -> Column:
    return F.xxhash64(own.cast("string"), text)


def _found(named: DataFrame) -> DataFrame:
    """(id, row, print, base, secrets, text) of every row; the text is kept only where there are base spans."""
    based = named.select("id", "row", "print", base_spans("text").alias("base"), "text")
    return based.select("id", "row", "print", "base", secret_spans("text").alias("secrets"), F.when(F.size("base") > 0, F.col("text")).alias("text"))


def _spans(found: DataFrame, texts: DataFrame, support: int, generalise: float, remove: float) -> DataFrame:
    """(row, base, spans) of the rows that have any; ``found``: a durable table as :func:`_found` gives."""
    own = found.where(F.size("base") > 0).dropDuplicates(["row"])
    once = own.dropDuplicates(["print"])
    entities = durable(_entities(own), "pii-entities")
    held = durable(_classes(entities).join(once.select("print", F.explode(F.array_distinct(_terms("text"))).alias("term")).hint("merge"), "print"), "pii-held", after=(entities,))
    flagged = disclosing_terms(held, texts, support, generalise, remove)
    removed = KINDS.index("remove")
    # a term of two entities takes the stronger kind
    strength = F.max(F.when(F.col("kind") == "remove", removed).otherwise(KINDS.index("generalise"))).alias("ord")
    hits = held.join(flagged.hint("merge"), ["class", "term"]).groupBy("print", "term").agg(strength)
    pieces = F.arrays_zip(F.split("text", F.lit(WORD), -1).alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))
    each = own.select("row", "print", F.posexplode(pieces).alias("i", "piece")).where("piece.word is not null")
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = each.select("row", "print", "piece.word", F.sum(F.length("piece.gap") + F.length("piece.word")).over(upto).cast("int").alias("stop"))
    places = places.select("row", "print", F.lower("word").alias("term"), (F.col("stop") - F.length("word")).alias("start"), "stop")
    span = F.struct("start", "ord", F.when(F.col("ord") == removed, "remove").otherwise("generalise").alias("kind"), "stop")
    extra = durable(places.join(hits.hint("merge"), ["print", "term"]).groupBy("row").agg(F.collect_list(span).alias("extra")), "pii-extra", after=(held,))
    small = found.where((F.size("base") > 0) | (F.size("secrets") > 0)).select("row", "base", "secrets").dropDuplicates(["row"])
    return small.join(extra.hint("merge"), "row", "left").select("row", "base", _all_spans().alias("spans"))


def _all_spans() -> Column:
    """``base``, ``secrets``, and those of ``extra`` that none of them overlaps, sorted."""
    known = F.concat("base", "secrets")
    clear = F.filter(F.coalesce("extra", F.expr(f"cast(array() as {SPAN})")), lambda t: ~F.exists(known, lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    return F.sort_array(F.concat(known, clear))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``base`` spans, and ``spans`` (base, secrets and disclosing terms).

    A span is (start, ord, kind, stop), in code points, the end exclusive; spans are sorted by start, then
    in the order of ``KINDS``. Null and empty texts have no spans. Equal texts, letters' case
    aside, count once; rows that repeat an id are rows of their own. A term that overlaps a pattern's match
    is not listed. An empty table gives an empty result. Other columns are not read.
    """
    named = _keyed(docs, id_col, text_col)
    found = durable(_found(named), "pii-found")
    spans = _spans(found, named.select("print", "text"), support, generalise, remove)
    some = (F.size("base") > 0) | (F.size("secrets") > 0)
    hit = found.where(some).select("id", "row").join(spans.hint("merge"), "row").select("id", "base", "spans")
    none = found.where(~some).select("id", "base", F.col("base").alias("spans"))
    return hit.unionByName(none).withColumnRenamed("id", id_col)


def sanitised_text(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its label; of overlapping spans the first counts."""
    label = "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in LABELS.items()) + "), s.kind)"
    step = f"""(a, s) -> if(s.start < a.pos, a, named_struct('pos', s.stop, 'out', concat(a.out, substring({text}, a.pos + 1, s.start - a.pos), {label})))"""
    return F.expr(f"aggregate({spans}, named_struct('pos', 0, 'out', ''), {step}, a -> concat(a.out, substring({text}, a.pos + 1)))")


def sanitise(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, personal data and disclosing terms of ``text_col`` replaced by labels.

    Rows without findings pass straight through, a null text stays null; no row goes. Edge cases are as in
    :func:`find_personal_data`.
    """
    names = docs.columns
    named = _keyed(docs, id_col, text_col)
    found = durable(_found(named).where((F.size("base") > 0) | (F.size("secrets") > 0)), "pii-found")
    spans = durable(_spans(found, named.select("print", "text"), support, generalise, remove).select("row", "spans"), "pii-spans", after=(found,))
    own = F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")
    packed = docs.select(own, plain_text(F.col(text_col)).alias("text"), F.col(id_col).alias("id")).select("own", "text", _row(F.col("id"), F.col("text")).alias("row"))
    flagged = maybe_in(packed, "row", bitmap(spans, "row"))
    clean = flagged.where("not maybe").select("own.*")
    hit = flagged.where("maybe").join(spans.hint("merge"), "row", "left").select("own", F.when(F.col("spans").isNotNull(), sanitised_text()).otherwise(F.col(f"own.`{text_col}`")).alias("text"))
    hit = hit.select(*[F.col("text").alias(c) if c == text_col else F.col(f"own.`{c}`").alias(c) for c in names])
    return clean.unionByName(hit)

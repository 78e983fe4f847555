"""Analyzer responses: recovery of their JSON, typed fallbacks, and the merge into one row a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strict_json import parse_json
from lectern.functions.text import fenced_body

# The fields of each analyzer's record, their types, and what they hold when an answer isn't
# JSON and when the analysis failed. {} stands for the error's text.
RECORDS = {
    "spec_check": {
        "compliant": ("boolean", False, False),
        "issues": ("array<string>", ["Failed to parse analysis results"], ["Analysis error: {}"]),
        "severity": ("string", "medium", "high"),
        "recommendations": ("array<string>", [], []),
    },
    "lcca": {
        "tco_considered": ("boolean", False, False),
        "cost_factors_identified": ("array<string>", [], []),
        "missing_considerations": ("array<string>", ["Failed to parse analysis"], ["Analysis error: {}"]),
        "severity": ("string", "medium", "high"),
        "recommendations": ("array<string>", [], []),
    },
    "market_scope": {
        "abc_reasonable": ("boolean", True, True),
        "market_price_range": ("string", "Unable to determine", "Analysis unavailable"),
        "supplier_availability": ("string", "unknown", "unknown"),
        "issues": ("array<string>", ["Failed to parse analysis"], ["Analysis error: {}"]),
        "severity": ("string", "low", "medium"),
        "recommendations": ("array<string>", [], []),
    },
    "green": {
        "green_criteria_included": ("boolean", False, False),
        "environmental_considerations": ("array<string>", [], []),
        "missing_criteria": ("array<string>", ["Failed to parse analysis"], ["Analysis error: {}"]),
        "severity": ("string", "low", "medium"),
        "recommendations": ("array<string>", [], []),
    },
    "tatak_pinoy": {
        "domestic_preference_applied": ("boolean", False, False),
        "local_content_considered": ("boolean", False, False),
        "compliance_issues": ("array<string>", ["Failed to parse analysis"], ["Analysis error: {}"]),
        "opportunities": ("array<string>", [], []),
        "severity": ("string", "low", "medium"),
        "recommendations": ("array<string>", [], []),
    },
    "compliance": {
        "recommended_modality": ("string", "Competitive Bidding", "Competitive Bidding"),
        "justification": ("string", "Default procurement mode", "Analysis error occurred"),
        "procurement_characteristics": ("array<string>", [], []),
        "compliance_requirements": ("array<string>", ["Failed to parse analysis"], ["Analysis error: {}"]),
        "severity": ("string", "low", "medium"),
        "recommendations": ("array<string>", [], []),
    },
}
ANALYZERS = tuple(RECORDS)
SEVERITIES = ("low", "medium", "high")


def record_schema(analyzer: str) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, *_) in RECORDS[analyzer].items())


def _filled(value, error: Column) -> Column:
    if isinstance(value, list):
        return F.array(*[_filled(x, error) for x in value]).cast("array<string>")
    if isinstance(value, str) and "{}" in value:
        return F.concat(F.lit(value.replace("{}", "")), error)
    return F.lit(value)


def fallback_record(analyzer: Column, error: Column) -> Column:
    """The JSON record that stands for an answer which can't be read; ``error``: null if it just isn't JSON."""
    out = F.lit(None).cast("string")
    for name, fields in RECORDS.items():
        record = lambda at: F.to_json(F.struct(*[_filled(v[at], error).alias(k) for k, v in fields.items()]))  # noqa: E731, B023
        out = F.when(analyzer == name, F.when(error.isNull(), record(1)).otherwise(record(2))).otherwise(out)
    return out


def recover(responses: DataFrame, response: str = "response", error: str = "error") -> DataFrame:
    """Adds ``record`` (JSON, never null), ``parsed``, ``severity`` and ``compliant`` to (analyzer, response, error).

    Any JSON value is a record as it is. What isn't JSON, and no answer at all, gives the analyzer's first
    fallback; a failed call, or JSON that can't be read for another reason, its second.
    """
    read = responses.withColumn("read", parse_json(fenced_body(F.col(response))))
    failed = F.coalesce(F.col(error), F.col("read.error"))
    parsed = F.col("read.body").isNotNull() & F.col(error).isNull()
    found = read.withColumn("parsed", parsed).withColumn("record", F.when(parsed, F.col("read.body")).otherwise(fallback_record(F.col("analyzer"), failed)))
    # the first field of four of the records says whether all is well; the first fallback of two isn't false
    verdict = F.coalesce(*[F.get_json_object("record", f"$.{next(iter(fields))}") for fields in RECORDS.values()])
    return found.drop("read").withColumns({"severity": F.get_json_object("record", "$.severity"), "compliant": verdict == "true"})


def typed_records(recovered: DataFrame, analyzer: str, *keys: str) -> DataFrame:
    """``keys`` and the typed fields of one analyzer's records; a field of another type is null."""
    own = recovered.where(F.col("analyzer") == analyzer).withColumn("r", F.from_json("record", record_schema(analyzer)))
    return own.select(*keys, *[F.col(f"r.{name}").alias(name) for name in RECORDS[analyzer]])


def rank_of(severity):
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int"), F.lit(0))


def merge_sessions(recovered: DataFrame, thread: str) -> DataFrame:
    """One row a session: the worst severity of each analyzer, ``n_analyzers``, ``n_parsed``.

    Disjoint keys of a merge are a pivot with known columns: one partial aggregation, one shuffle.
    """
    worst = [F.max(F.when(F.col("analyzer") == a, rank_of(F.col("severity")))).alias(a) for a in ANALYZERS]
    any_of = lambda what: [F.max(F.when(F.col("analyzer") == a, what).otherwise(0)) for a in ANALYZERS]
    merged = recovered.groupBy(thread).agg(*worst, sum(any_of(F.lit(1)), F.lit(0)).alias("n_analyzers"), sum(any_of(F.col("parsed").cast("int")), F.lit(0)).alias("n_parsed"))
    name = lambda a: F.get(F.array(*map(F.lit, SEVERITIES)), F.col(a) - 1).alias(a)
    return merged.select(thread, *[name(a) for a in ANALYZERS], "n_analyzers", "n_parsed")


def merge_maps(left, right):
    """Two maps of maps, united one level down; the right side wins, with its nulls too."""
    one = lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda k2, x, y: F.when(F.map_contains_key(b, k2), y).otherwise(x)))
    return F.map_zip_with(left, right, one)


def fold_updates(updates: DataFrame, thread: str, order: str, update: str) -> DataFrame:
    """(thread, section, field, value): any number of partial results (JSON objects of sections) merged in their order.

    A section that is an object is united with what was there, field by field, the later value winning, null
    too; any other value, null too, replaces the section, and an object replaces such a value. ``value`` is
    JSON text; a section that is no object, or an empty one, has one row with a null ``field``. What isn't
    a JSON object changes nothing. Places are unique in a thread; of equal ones a value that is no object goes before
    one that is, and a greater text before a smaller one.

    All is by grouped maxima of places, so partial aggregates meet in any order and no task holds a session.
    """
    parsed = F.try_variant_get(F.try_parse_json(F.col(update)), "$", "map<string,variant>")
    rows = updates.select(F.col(thread).alias("thread"), F.col(order).alias("place"), F.explode(parsed).alias("section", "v"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    each = rows.select("thread", "place", "section", fields.alias("fields"), F.to_json("v").alias("value"))
    plain = F.when(F.col("fields").isNull(), F.struct("place", "value"))
    last = each.groupBy("thread", "section").agg(F.max(plain).alias("plain"), F.max(F.when(F.col("fields").isNotNull(), F.col("place"))).alias("last_object"))
    is_object = F.col("last_object").isNotNull() & (F.col("plain").isNull() | (F.col("last_object") > F.col("plain.place")))
    inner = each.select("thread", "place", "section", F.explode("fields").alias("field", "v")).groupBy("thread", "section", "field")
    newest = inner.agg(F.max(F.struct("place", F.to_json("v").alias("value"))).alias("own"))
    objects = last.where(is_object).select("thread", "section", F.col("plain.place").alias("cut"))
    same = F.col("o.thread").eqNullSafe(F.col("n.thread")) & (F.col("o.section") == F.col("n.section"))
    later = F.col("cut").isNull() | (F.col("n.own.place") > F.col("cut"))
    # sorted and merged: both sides grow with the updates, so neither is broadcast. An object without later fields is an empty one
    kept = objects.alias("o").hint("merge").join(newest.alias("n"), same & later, "left")
    found = kept.select("o.thread", "o.section", "field", F.when(F.col("n.own").isNull(), "{}").otherwise(F.col("n.own.value")).alias("value"))
    others = last.where(~is_object).select("thread", "section", F.lit(None).cast("string").alias("field"), F.col("plain.value").alias("value"))
    return found.unionByName(others).withColumnRenamed("thread", thread)

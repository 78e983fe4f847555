"""From merged analyses to verdicts, findings and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strict_json import shaped_json
from lectern.functions.text import compiled_body
from lectern.operators.analysis import ANALYZERS

NAMES = dict(zip(ANALYZERS, ("Specifications", "Lifecycle cost", "Market scope", "Sustainability", "Domestic preference", "Modality")))
# Labels, lines of advice, and the verdicts that stand for a compilation which failed.
LABELS = {"high": "Critical Risk", "medium": "Moderate Risk", "low": "Minor Issue"}
ADVICE = {
    "PASS": ("This procurement document meets all compliance requirements.", "No critical issues were identified during the analysis.", "The document is ready to proceed to the next stage."),
    "FAIL": ("Address all high-severity findings before proceeding.", "Review medium-severity items for potential improvements.", "Consider re-submission after corrections are made."),
}
INCOMPLETE = ("Analysis Incomplete", 50, "Failed to compile report: ")
EMERGENCY = ("System Error During Analysis", 0, "Critical error: ")
VERDICT = "status string, title string, confidence int, findings array<struct<category: string, items: array<string>, severity: string>>"

_shaped = shaped_json(("status", "title"))


def _failed(kind: tuple[str, int, str], why: Column) -> Column:
    title, confidence, prefix = kind
    finding = F.struct(F.lit("System Error").alias("category"), F.array(F.concat(F.lit(prefix), F.coalesce(why, F.lit("unknown")))).alias("items"), F.lit("high").alias("severity"))
    return F.struct(F.lit("FAIL").alias("status"), F.lit(title).alias("title"), F.lit(confidence).alias("confidence"), F.array(finding).alias("findings"))


def compile_verdicts(answers: DataFrame, response: str = "response", error: str = "error", has_results: str | None = None) -> DataFrame:
    """Adds ``report`` (JSON) and ``verdict`` (typed) to a compiler's answers.

    An answer must be JSON in which status and title are present; else the verdict is incomplete. A failed
    call, JSON without keys to look up, and a session without any analysis (``has_results``) give the
    emergency verdict. Values aren't checked: an unknown status or a confidence of 900 stays.
    """
    read = answers.withColumn("read", _shaped(compiled_body(F.col(response))))
    missing = F.lit(None).cast("string") if has_results is None else F.when(~F.coalesce(F.col(has_results), F.lit(False)), "No analysis results found in state")
    why = F.coalesce(missing, F.col(error), F.col("read.error"))
    fallback = F.when(why.isNotNull(), _failed(EMERGENCY, why)).otherwise(_failed(INCOMPLETE, F.col("read.problem")))
    report = F.when(why.isNull() & F.col("read.body").isNotNull(), F.col("read.body")).otherwise(F.to_json(fallback))
    return read.withColumn("report", report).drop("read").withColumn("verdict", F.from_json("report", VERDICT))


def verdicts(merged: DataFrame, thread: str) -> DataFrame:
    """Adds ``status``, ``title``, ``confidence`` and ``findings`` (analyzers above low, in fixed order).

    The rule and the confidence are ours: a session fails on any finding of high severity, confidence is
    the share of analyzers that could be read. A session that lacks an analyzer is incomplete: it fails,
    and has one finding that says so.
    """
    findings = F.filter(
        F.array(*[F.struct(F.lit(NAMES[a]).alias("category"), F.array(F.lit(f"Review of {a}"), F.concat(F.lit("Severity "), F.col(a))).alias("items"), F.col(a).alias("severity")) for a in ANALYZERS]),
        lambda f: f["severity"].isin("medium", "high"),
    )
    complete = F.col("n_analyzers") == len(ANALYZERS)
    lacking = _failed(INCOMPLETE, F.concat(F.lit("of six analyses there are "), F.col("n_analyzers").cast("string")))
    found = merged.withColumn("complete", complete).withColumn("findings", F.when(F.col("complete"), findings).otherwise(lacking["findings"]))
    high = F.exists("findings", lambda f: f["severity"] == "high")
    status = F.when(F.col("complete") & ~high, "PASS").otherwise("FAIL")
    return found.select(
        thread, status.alias("status"), F.when(~F.col("complete"), INCOMPLETE[0]).when(status == "PASS", "Review Passed").otherwise("Review Failed").alias("title"),
        F.when(F.col("complete"), F.round(100 * F.col("n_parsed") / len(ANALYZERS)).cast("int")).otherwise(INCOMPLETE[1]).alias("confidence"), "findings",
    )


def unnest_findings(found: DataFrame, thread: str) -> DataFrame:
    """One row per item: ``finding_no`` and ``item_no`` from 1; a finding without items keeps a row."""
    each = found.select(thread, F.posexplode("findings").alias("k", "f"))
    items = each.select(thread, (F.col("k") + 1).alias("finding_no"), "f.category", "f.severity", F.posexplode_outer("f.items").alias("j", "item"))
    return items.select(thread, "finding_no", "category", "severity", (F.col("j") + 1).alias("item_no"), "item")


def top_categories(findings="findings"):
    """The categories among the first two findings, joined by "and"."""
    return F.array_join(F.filter(F.transform(F.slice(findings, 1, 2), lambda f: f["category"]), lambda c: c != ""), " and ")


def intro():
    """One sentence that introduces a verdict."""
    top = top_categories()
    # Fixed values
    areas = F.when(top == "", "I can walk you through the key findings.").otherwise(F.concat(F.lit("Key risk areas: "), top, F.lit(".")))
    return F.concat(F.lit("Analysis complete: "), F.col("status"), F.lit(" with "), F.col("confidence").cast("string"), F.lit("% confidence. "), areas, F.lit(" Which part should we review first?"))


def recommendations(found: DataFrame, thread: str) -> DataFrame:
    return found.select(thread, F.posexplode(_advice()).alias("k", "recommendation")).select(thread, (F.col("k") + 1).alias("n"), "recommendation")


def _advice() -> Column:
    return F.when(F.col("status") == "PASS", F.array(*map(F.lit, ADVICE["PASS"]))).otherwise(F.array(*map(F.lit, ADVICE["FAIL"])))


def report_lines(found: DataFrame, thread: str) -> DataFrame:
    """(thread, line_no, section, text): the report as lines, ready for ``write.text``.

    Heading, status and confidence, the title, a summary, numbered findings with their items as bullets,
    and the advice for the status. Pages and fonts are a renderer's affair.
    """
    line = lambda section, text: F.struct(F.lit(section).alias("section"), text.alias("text"))
    head = F.array(
        line("heading", F.lit("PROCUREMENT DOCUMENT ANALYSIS")), line("status", F.concat(F.lit("Status: "), F.col("status"))),
        line("confidence", F.concat(F.lit("Confidence: "), F.col("confidence").cast("string"), F.lit("%"))), line("title", F.col("title")),
        line("summary", F.concat(F.lit("Findings: "), F.size("findings").cast("string"))),
    )
    bullet = lambda section: lambda x: line(section, F.concat(F.lit("• "), x))
    numbered = lambda f, k: line("finding", F.concat((k + 1).cast("string"), F.lit(". "), f["category"], F.lit(" ["), F.upper(f["severity"]), F.lit("]")))
    body = F.flatten(F.transform("findings", lambda f, k: F.concat(F.array(numbered(f, k)), F.transform(f["items"], bullet("item")))))
    return found.select(thread, F.posexplode(F.concat(head, body, F.transform(_advice(), bullet("recommendation")))).alias("line_no", "l")).select(thread, "line_no", "l.section", "l.text")

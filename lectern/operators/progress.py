"""Progress logs folded into lanes, states and terminal events. A log has a bigint order ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.strict_json import strict_json
from lectern.operators.chat import event

TIMEOUT_S = 300


# What agents are called where their progress is shown; others keep their names.
DISPLAY_NAMES = {
    "PDF Parser": "Document Extraction",
    "Specification Validator": "Specification Validation",
    "LCCA Analyzer": "Cost Analysis",
    "Market Researcher": "Market Research",
    "Sustainability Analyst": "Sustainability Check",
    "Domestic Preference Checker": "Tatak Pinoy Verification",
    "Modality Advisor": "Compliance Review",
    "Report Compiler": "Report Generation",
    "Gamma Generator": "Final Processing",
}


def display_name(agent):
    names = F.create_map(*[F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair])
    return F.coalesce(names[agent], agent)


def agent_lanes(logs: DataFrame, thread: str, agent: str, complete=None, ts: str | None = None) -> DataFrame:
    """One row per (thread, agent): last message, first and last ``seq`` (and time), ``lane`` in first-seen order, ``status``.

    The agent that owns a thread's last row is active unless ``complete`` holds; what the logs say of their
    own status doesn't count. The aggregate keeps sequence numbers only, which hashes; the messages are
    joined back by the last of them. Only one row per lane reaches the windows.
    """
    lanes = logs.groupBy(thread, agent).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    of = lambda side: logs.select(thread, agent, F.col("seq").alias(f"{side}_seq"), *([F.col(ts).alias(f"{side}_ts")] if ts else []), *(["message"] if side == "last" else []))
    found = lanes.join(of("last"), [thread, agent, "last_seq"])
    found = found.join(of("first"), [thread, agent, "first_seq"]) if ts else found
    last = F.col("last_seq") == F.max("last_seq").over(Window.partitionBy(thread))
    done = F.lit(False) if complete is None else complete
    times = ["first_ts", "last_ts"] if ts else []
    lane = F.row_number().over(Window.partitionBy(thread).orderBy("first_seq")).alias("lane")
    return found.select(thread, agent, "message", "first_seq", "last_seq", *times, lane, F.when(last & ~done, "active").otherwise("complete").alias("status"))


def append_logs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Logs of parallel agents, one after the other; a side that isn't there is empty."""
    return left.unionByName(right)


def first_by_id(logs: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with equal ids the first stays; a grouped minimum, so repeats meet as partial aggregates."""
    rest = [c for c in logs.columns if c not in (key, order)]
    kept = logs.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return kept.select(key, *[F.col(f"r.{c}").alias(c) for c in logs.columns if c != key])


def active_and_complete(logs: DataFrame) -> DataFrame:
    """Each log twice, as it becomes active and complete."""
    return logs.withColumn("status", F.explode(F.array(F.lit("active"), F.lit("complete"))))


def thread_facts(logs: DataFrame, thread: str, ts: str) -> DataFrame:
    """(thread, n_logs, n_errors, span_s, timed_out): what a connection's end depends on."""
    span = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    facts = logs.groupBy(thread).agg(F.count(F.lit(1)).alias("n_logs"), F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("n_errors"), span.alias("span_s"))
    return facts.withColumn("timed_out", F.col("span_s") > TIMEOUT_S)


def terminal_event(has_verdict, n_errors, timed_out):
    """A verdict beats an error, and an error a timeout."""
    return F.when(has_verdict, "complete").when(n_errors > 0, "error").when(timed_out, "timeout").otherwise("open")


def session_status(has_logs, has_verdict):
    return F.when(has_verdict, "complete").when(has_logs, "processing").otherwise("not_started")


def analysis_events(logs: DataFrame, sessions: DataFrame, thread: str) -> DataFrame:
    """(thread, seq, event, data): a session's logs, and then how it ends.

    ``logs`` has (thread, seq, id, agent, message, timestamp, status), ``sessions`` one row a session:
    (thread, report, error, timed_out). A report comes before a task's error, and that before the timeout;
    a report that isn't JSON is an error. A session with none of these is open and has no end yet.
    """
    log = logs.select(thread, "seq", event("thinking_log", **{k: F.col(k) for k in ("id", "agent", "message", "timestamp", "status")}).alias("e"))
    read = sessions.withColumn("body", strict_json(F.col("report")))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    said = lambda text: F.array(event("error", error=text))
    verdict = F.array(F.struct(F.lit("verdict").alias("event"), F.col("body").alias("data")), event("complete", status=F.lit("awaiting_review")))
    end = F.when(some("report") & F.col("body").isNotNull(), verdict).when(some("report"), said(F.lit("Invalid verdict format")))
    end = end.when(F.col("error").isNotNull(), said(F.coalesce("error", F.lit("Unknown error")))).when(F.col("timed_out"), said(F.lit("Analysis timeout")))
    # behind every log
    ends = read.select(thread, F.posexplode(end).alias("k", "e")).select(thread, (F.lit((1 << 63) - 3) + F.col("k")).alias("seq"), "e")
    return log.unionByName(ends).select(thread, "seq", "e.event", "e.data")


def status_of(has_state, report, link, n_logs):
    """Struct (status, has_verdict, has_gamma, thinking_logs_count) of a session; empty texts count as none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.struct(
        session_status(has_state, some(report)).alias("status"), some(report).alias("has_verdict"), some(link).alias("has_gamma"), F.coalesce(n_logs, F.lit(0)).alias("thinking_logs_count")
    )

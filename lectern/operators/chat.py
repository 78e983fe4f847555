"""Chat transcripts: reassembly of deltas, gates, roles and event-stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.strict_json import frame_payloads
from lectern.functions.text import strip

MOST_QUERY = 5000


def reassemble(deltas: DataFrame, message: str, order: str, delta: str) -> DataFrame:
    """(message, n_deltas, response): the deltas of each message in order, empty ones skipped.

    A message's deltas meet in one row, as its text does; a message is an answer, of bounded length.
    """
    parts = deltas.where(F.col(delta) != "").groupBy(message).agg(F.sort_array(F.collect_list(F.struct(order, delta))).alias("parts"))
    return parts.select(message, F.size("parts").alias("n_deltas"), F.array_join(F.col(f"parts.{delta}"), "").alias("response"))


def shown_messages(deltas: DataFrame, finals: DataFrame, message: str, order: str, delta: str) -> DataFrame:
    """(message, content): what a client shows. Blank deltas before the first other one are left out; a final
    response (message, response), where there is one, takes the place of what was put together."""
    parts = deltas.where(F.col(delta) != "").groupBy(message).agg(F.sort_array(F.collect_list(F.struct(order, delta))).alias("parts"))
    said = parts.select(message, F.col(f"parts.{delta}").alias("d"))
    # the first delta that isn't blank
    first = F.array_position(F.transform("d", lambda x: strip(x) != ""), True)
    joined = said.withColumn("first", first.cast("int"))
    joined = joined.select(message, F.when(F.col("first") > 0, F.array_join(F.slice("d", F.col("first"), F.size("d")), "")).alias("joined"))
    both = joined.join(finals.select(message, F.col("response").alias("final")), message, "full")
    return both.select(message, F.coalesce("final", "joined").alias("content")).where("content is not null")


def upsert(messages: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Messages by id: a changed one keeps its first place (``order``) and takes the last row's other columns."""
    rest = [c for c in messages.columns if c not in (key, order)]
    rows = messages.unionByName(changes)
    ends = rows.groupBy(F.col(key).alias("of")).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    last = rows.join(ends, (F.col(key) == F.col("of")) & (F.col(order) == F.col("last"))).dropDuplicates([key])
    return last.select(key, F.col("first").alias(order), *rest)


def query_gate(query):
    """``ok``, or why a query is turned away: its length before trimming, or nothing left after it."""
    n = F.length(F.coalesce(query, F.lit("")))
    return F.when((n < 1) | (n > MOST_QUERY), "bad_length").when(strip(query) == "", "empty").otherwise("ok")


def message_type(role):
    return F.when(role == "user", "user").otherwise("ai")


def chat_precondition(has_session, has_state, text):
    """The error code before a chat: 404 without session or state, 400 without text, else null."""
    return F.when(~has_session | ~has_state, 404).when(F.coalesce(text, F.lit("")) == "", 400)


def message_list(uploads: DataFrame, progress: DataFrame, chat: DataFrame, order: str) -> DataFrame:
    """Uploads, then progress, then chat, each in its order: ``section`` 0 to 2 is the first key to sort by."""
    each = [x.withColumn("section", F.lit(k)) for k, x in enumerate((uploads, progress, chat))]
    return each[0].unionByName(each[1], allowMissingColumns=True).unionByName(each[2], allowMissingColumns=True).orderBy("section", order)


# --- event streams -----------------------------------------------------------------------------------


def parse_frame(frame):
    """Struct (event, data) of one event-stream frame: the last event line wins, data lines are joined; without any data is null."""
    lines = F.transform(F.split(F.regexp_replace(frame, "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    values = lambda field: F.transform(F.filter(lines, lambda x: x.startswith(field + ":")), lambda x: F.regexp_replace(F.substring(x, F.lit(len(field) + 2), F.length(x)), r"(?U)^\s+", ""))
    data = values("data")
    return F.struct(F.coalesce(F.get(F.reverse(values("event")), F.lit(0)), F.lit("message")).alias("event"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))


def stream_frames(streams: DataFrame, key: str, body: str) -> DataFrame:
    """(key, frame_no, event, payload, problem) of whole event streams: one row a frame that has data.

    Line ends are made alike, frames are cut at blank lines, what follows the last blank line is not a
    frame yet. The payload is the data's canonical JSON. A client reads no further than the first
    ``problem``: data that isn't JSON, or an ``error`` event, whose message it is. Keys are unique.
    """
    whole = F.split(F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "\r", "\n"), "\n\n", -1)
    frames = streams.select(key, F.posexplode(F.slice(whole, F.lit(1), F.size(whole) - 1)).alias("frame_no", "frame"))
    parsed = frames.where(strip(F.col("frame")) != "").select(key, "frame_no", parse_frame(strip(F.col("frame"))).alias("f")).where("f.data is not null")
    read = parsed.select(key, "frame_no", "f.event", frame_payloads("f.event", "f.data").alias("j")).select(key, "frame_no", "event", "j.*")
    ends = F.min(F.when(F.col("problem").isNotNull(), F.col("frame_no"))).over(Window.partitionBy(key))
    return read.withColumn("ends", ends).where(F.col("ends").isNull() | (F.col("frame_no") <= F.col("ends"))).drop("ends")


def event(name: str, **fields: Column) -> Column:
    """Struct (event, data): an event with its fields as JSON."""
    return F.struct(F.lit(name).alias("event"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias("data"))


def chat_events(deltas: DataFrame, ends: DataFrame, message: str, order: str, delta: str) -> DataFrame:
    """(message, seq, event, data): start, deltas, and the end of each chat answer.

    ``ends`` has one row a message: (message, started, ended, disconnected, error), times in milliseconds.
    A client that has gone gets no end; an error takes its place. Empty deltas are not sent.
    """
    start = ends.select(message, F.lit(-1).cast("long").alias("seq"), event("chat_start", message_id=F.col(message), timestamp=F.col("started")).alias("e"))
    each = deltas.where(F.col(delta) != "").select(message, F.col(order).cast("long").alias("seq"), event("chat_delta", message_id=F.col(message), delta=F.col(delta)).alias("e"))
    said = ends.where(~F.coalesce("disconnected", F.lit(False)) | F.col("error").isNotNull()).join(reassemble(deltas, message, order, delta), message, "left")
    done = event("chat_complete", message_id=F.col(message), response=F.coalesce("response", F.lit("")), timestamp=F.col("ended"))
    failed = event("error", message_id=F.col(message), error=F.col("error"))
    end = said.select(message, F.lit((1 << 63) - 1).alias("seq"), F.when(F.col("error").isNotNull(), failed).otherwise(done).alias("e"))
    return start.unionByName(each).unionByName(end).select(message, "seq", "e.event", "e.data")

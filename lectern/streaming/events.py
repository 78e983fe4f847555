"""Live events: logs and chat deltas in, (event, data) rows out, exactly once a micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.streaming.chat_stream import chat_stream

POLL = "500 milliseconds"
#: Whether a query goes on without new rows; it takes the setting that holds when it starts.
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def event_sink(stream: DataFrame, to_events: Callable[[DataFrame], DataFrame], folder: str, once: bool = False) -> StreamingQuery:
    """Writes the events of each micro-batch under ``folder/events/batch=N``.

    A batch that is run again after a failure replaces its own rows. New input is looked for every
    ``POLL``; with ``once`` the query ends when it has read what there is.
    """

    def write(batch: DataFrame, number: int) -> None:
        to_events(batch).write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": POLL}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()


def chat_sink(stream: DataFrame, folder: str, once: bool = False, silence: int = 300) -> StreamingQuery:
    """Writes the chat events of a stream of (message_id, seq, kind, delta, timestamp), see :func:`chat_stream`.

    Recorded rows come as fast as the job reads them, so their ``silence`` is longer than a job may last.
    With ``once`` timers are looked at with the new rows only, as a query with timers would else wait for ever.
    """
    spark = stream.sparkSession
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(not once).lower())
    try:
        return event_sink(chat_stream(stream, silence=silence), lambda events: events, folder, once)
    finally:
        spark.conf.set(IDLE_BATCHES, before)


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    """All events that a sink has written under ``folder``."""
    return spark.read.parquet(f"{folder}/events")


def timeouts(stream: DataFrame, thread: str, over: str, seconds: int = 300) -> DataFrame:
    """(thread, event): ``error`` for each session that isn't over after so many seconds of wall-clock time.

    The clock of a session starts with its first row; ``over``: a boolean column that says a row ends it,
    which gives ``complete``. What comes after the end is ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended = state.exists and state.get[0]
        if state.hasTimedOut:
            state.update((True, state.get[1]))
            yield pd.DataFrame({thread: [key[0]], "event": ["error"]})
            return
        now = state.getCurrentProcessingTimeMs()
        started = state.get[1] if state.exists else now
        if not ended and any(b[over].any() for b in batches):
            ended = True
            yield pd.DataFrame({thread: [key[0]], "event": ["complete"]})
        state.update((ended, started))
        if not ended:
            state.setTimeoutDuration(max(1, started + 1000 * seconds - now))

    kind = stream.schema[thread].dataType.simpleString()
    return stream.select(thread, over).groupBy(thread).applyInPandasWithState(step, f"{thread} {kind}, event string", "ended boolean, started long", "append", GroupStateTimeout.ProcessingTimeTimeout)

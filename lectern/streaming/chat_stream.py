"""Chat answers as they are generated: one keyed state per message, whose work follows the new rows only.

A message's rows have a gapless ``seq`` from ``first`` on. They are sent in that order, whatever order they
come in: a row that comes too early waits in the state, one that comes again is dropped. The pieces of the
answer are read once when the message ends, but for a short rest; a timer ends messages that have fallen silent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where the end of a message stands in ``seq``.
END = (1 << 63) - 1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SILENT = "Chat stream timed out"

#: What a message's facts hold of its text and of rows that came too early: rows or pieces, and characters. The rest goes to states of its own.
NEAR, NEAR_CHARS = 64, 8192

_FACTS = T.StructType().add("next", T.LongType()).add("over", T.BooleanType()).add("seen", T.LongType()).add("listed", T.BooleanType()).add("kept", T.LongType()).add("pieces", T.LongType()).add("said", T.StringType()).add("early", T.StringType())
_PART = T.StructType().add("text", T.StringType())
_BLOCK = T.StructType().add("block", T.LongType())
_WAITING = T.StructType().add("rows", T.StringType())


def _event(message, seq: int, event: str, **fields) -> Row:
    return Row(message_id=message, seq=seq, event=event, data=_data(message_id=message, **fields))


_encoded = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def _data(**fields) -> str:
    return _encoded(fields)


def _packed(rows: dict[int, tuple]) -> str:
    return json.dumps([(seq, *row) for seq, row in rows.items()])


def _unpacked(rows: str) -> dict[int, tuple]:
    return {seq: tuple(row) for seq, *row in json.loads(rows)}


class ChatProcessor(StatefulProcessor):
    """The state of a message: what comes next, the text so far, and rows that came too early.

    Each call to a state is a round trip to the JVM, so what is short lies in one value that is read and written once a
    batch; longer texts go to a list that is read at the end, further rows to a map of ``NEAR`` places an entry.
    """

    def __init__(self, first: int, silence_ms: int):
        self.first, self.silence_ms = first, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _FACTS)
        self.parts = handle.getListState("parts", _PART)
        self.waiting = handle.getMapState("waiting", _BLOCK, _WAITING)

    def _over(self, at: int, now: int) -> None:
        self.facts.update((at, True, now, False, 0, 0, "", "[]"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = tuple(self.facts.get() or ())
        if not known:  # the one timer of a message; it moves on when it is due, see below
            self.handle.registerTimer(now + self.silence_ms)
        at, over, _, listed, stored, pieces, text, early = known or (self.first, False, now, False, 0, 0, "", "[]")
        if over:  # what comes after the end is ignored
            self._over(at, now)
            return
        new = {}
        for r in rows:
            if r.seq is not None and r.seq >= at:
                new.setdefault(r.seq, (r.kind, r.delta, r.timestamp))
        new = _unpacked(early) | new
        blocks: dict[int, dict[int, tuple]] = {}
        changed = set()

        def block(seq: int) -> dict[int, tuple]:
            number = seq // NEAR
            if number not in blocks:
                found = self.waiting.getValue((number,)) if stored else None
                blocks[number] = _unpacked(found[0]) if found else {}
            return blocks[number]

        out: list[Row] = []
        said: list[str] = []
        kept = stored
        while not over:
            row = new.pop(at, None)
            if kept and at in block(at):
                old = block(at).pop(at)
                kept -= 1
                changed.add(at // NEAR)
                row = row or old
            if row is None:
                break
            over = self._sent(key[0], at, *row, listed, text, said, out)
            at += 1
        if over:
            if listed:
                self.parts.clear()
            if stored:
                self.waiting.clear()
            self._over(at, now)
        else:
            pieces, text = pieces + len(said), text + "".join(said)
            if pieces > NEAR or len(text) > NEAR_CHARS:
                self.parts.appendList([(text,)])
                listed, pieces, text = True, 0, ""
            if len(new) > NEAR or sum(len(delta or "") for _, delta, _ in new.values()) > NEAR_CHARS:
                for seq, row in new.items():
                    kept += seq not in block(seq)
                    block(seq)[seq] = row
                    changed.add(seq // NEAR)
                new = {}
            for number in changed:
                if blocks[number]:
                    self.waiting.updateValue((number,), (_packed(blocks[number]),))
                elif stored:
                    self.waiting.removeKey((number,))
            self.facts.update((at, False, now, listed, kept, pieces, text, _packed(new)))
        yield from out

    def _sent(self, message, seq: int, kind: str | None, delta: str | None, timestamp: int | None, listed: bool, text: str, said: list[str], out: list[Row]) -> bool:
        """Sends what a row gives; true if the message ends with it."""
        if kind == "start":
            out.append(_event(message, seq, "chat_start", timestamp=timestamp))
        elif kind == "delta" and delta:
            said.append(delta)
            out.append(_event(message, seq, "chat_delta", delta=delta))
        elif kind == "complete":
            response = "".join([*((p[0] for p in self.parts.get()) if listed else ()), text, *said])
            out.append(_event(message, END, "chat_complete", response=response, timestamp=timestamp))
        elif kind == "error":
            out.append(_event(message, END, "error", error=delta))
        return kind in ("complete", "error", "gone")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = tuple(self.facts.get() or ())
        if not known:
            return
        at, over, seen, listed, stored, *_ = known
        now = timerValues.getCurrentProcessingTimeInMs()
        if seen + self.silence_ms > now:  # rows came since the timer was set
            self.handle.registerTimer(seen + self.silence_ms)
            return
        if over:  # the message has been over for long: nothing of it stays
            self.facts.clear()
            return
        if listed:
            self.parts.clear()
        if stored:
            self.waiting.clear()
        self._over(at, now)
        self.handle.registerTimer(now + self.silence_ms)
        yield _event(key[0], END, "error", error=SILENT)

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Lists, maps and timers of a key need the state store that is kept on disk. Queries that run already keep theirs."""
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


def chat_stream(stream: DataFrame, first: int = -1, silence: int = 300) -> DataFrame:
    """(message_id, seq, event, data): the events of a stream of (message_id, seq, kind, delta, timestamp).

    ``kind`` is start, delta, complete, gone or error. Empty deltas aren't sent. When a message is complete
    its whole response is sent; a client that has gone gets nothing more; an error carries its text in
    ``delta``. ``seq`` counts a message's rows from ``first`` without gaps; rows are sent in that order and
    each once, and rows past the end or without a ``seq`` are dropped. A message that gets no row for
    ``silence`` seconds by the clock ends with an error, and so long after its end its state goes.
    """
    keyed_state(stream.sparkSession)
    kind = stream.schema["message_id"].dataType
    out = T.StructType().add("message_id", kind).add("seq", T.LongType()).add("event", T.StringType()).add("data", T.StringType())
    rows = stream.select("message_id", F.col("seq").cast("long").alias("seq"), "kind", "delta", F.col("timestamp").cast("long").alias("timestamp"))
    return rows.groupBy("message_id").transformWithState(ChatProcessor(first, 1000 * silence), out, "append", "processingTime")

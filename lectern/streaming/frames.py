"""Event-stream frames from bytes that arrive in chunks, cut anywhere: within a frame, a line end or a character.

The parser carries what isn't a frame yet. It ends, as a client does, at the first frame whose data isn't
JSON and at the first ``error`` event. In batch it goes through each stream's chunks in order, in a partition
sorted by stream, so that a stream's size isn't bounded by memory; as a stream it is a keyed state.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.strict_json import frame_payload
from lectern.streaming.chat_stream import keyed_state

# What a client counts as white space.
BLANK = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


class Frame(NamedTuple):
    frame_no: int
    event: str
    payload: str | None
    problem: str | None


class FrameParser:
    """Bytes in, frames out. ``frame_no`` counts the pieces between blank lines, comments and empty ones too."""

    def __init__(self, state: tuple[bytes, str, int, bool, bool] = (b"", "", 0, False, False)):
        undecoded, text, self.frame_no, self.stopped, self._began = state
        self._decode = codecs.getincrementaldecoder("utf-8")("replace")
        self._decode.decode(undecoded)
        self._parts, self._ends_line = [text] if text else [], text.removesuffix("\r").endswith("\n")

    def state(self) -> tuple[bytes, str, int, bool, bool]:
        """All that goes on with the next chunk."""
        return self._decode.getstate()[0], "".join(self._parts), self.frame_no, self.stopped, self._began

    def feed(self, chunk: bytes | None, last: bool = False) -> Iterator[Frame]:
        """The frames that end with this chunk; ``last``: no more chunks come, so cut characters are replaced."""
        if self.stopped:
            return
        text = self._decode.decode(chunk or b"", last)
        if text and not self._began:  # a byte order mark isn't text
            self._began, text = True, text.removeprefix("\ufeff")
        held = self._parts[-1] if self._parts else ""
        if held.endswith("\r"):  # the line end may have been cut in two
            self._parts[-1] = held[:-1]
            text = "\r" + text
        cut = "" if last or not text.endswith("\r") else "\r"
        text = (text[:-1] if cut else text).replace("\r\n", "\n").replace("\r", "\n")
        whole = "\n\n" in text or (self._ends_line and text.startswith("\n"))
        if not whole:
            if text:
                self._parts.append(text)
                self._ends_line = text.endswith("\n")
            if cut:
                self._parts.append(cut)
            return
        frames = ("".join(self._parts) + text).split("\n\n")
        rest = frames.pop()
        self._parts, self._ends_line = [x for x in (rest, cut) if x], rest.endswith("\n")
        for raw in frames:
            found = self._parsed(raw.strip(BLANK))
            self.frame_no += 1
            if found:
                yield found
                if found.problem is not None:
                    self.stopped, self._parts = True, []
                    return

    def _parsed(self, raw: str) -> Frame | None:
        event, data = "message", []
        for line in raw.split("\n"):
            line = line.rstrip(BLANK)
            if line.startswith("event:"):
                event = line[6:].strip(BLANK)
            elif line.startswith("data:"):
                data.append(line[5:].lstrip(BLANK))
        if not data:
            return None
        return Frame(self.frame_no, event, *frame_payload(event, "\n".join(data)))


_OUT = T.StructType().add("frame_no", T.LongType()).add("event", T.StringType()).add("payload", T.StringType()).add("problem", T.StringType())


def chunked_frames(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, frame_no, event, payload, problem) of streams given as chunks of bytes, ``order`` within each.

    A stream ends with its first ``problem``: data that isn't JSON, or an ``error`` event, whose message it is.
    What follows the last blank line is no frame. Null chunks are empty; of chunks with an equal place all
    count, in the order of their bytes. A stream of null key is a stream. An empty table gives an empty result.
    """
    kind = chunks.schema[key].dataType
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(chunk).cast("binary").alias("chunk"))
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "at", "chunk")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, current, out = None, None, []

        def end():
            return [(current, *f) for f in parser.feed(b"", last=True)] if parser else []

        for batch in batches:
            keys = batch["key"].astype(object).where(batch["key"].notna(), None)
            for k, data in zip(keys, batch["chunk"]):
                if parser is None or k != current:
                    out += end()
                    parser, current = FrameParser(), k
                out += [(k, *f) for f in parser.feed(data)]
            yield pd.DataFrame(out, columns=["key", *_OUT.names])
            out = []
        yield pd.DataFrame(end(), columns=["key", *_OUT.names])

    schema = T.StructType([T.StructField("key", kind), *_OUT.fields])
    return sorted_rows.mapInPandas(parse, schema).withColumnRenamed("key", key)


_STATE = T.StructType().add("undecoded", T.BinaryType()).add("text", T.StringType()).add("frame_no", T.LongType()).add("stopped", T.BooleanType()).add("began", T.BooleanType()).add("next", T.LongType())
_AT = T.StructType().add("seq", T.LongType())
_CHUNK = T.StructType().add("chunk", T.BinaryType())


class FrameProcessor(StatefulProcessor):
    """The parser's state of a stream, and the chunks that came too early."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carried = handle.getValueState("carried", _STATE)
        self.waiting = handle.getMapState("waiting", _AT, _CHUNK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        undecoded, *carried, at = tuple(self.carried.get()) if self.carried.exists() else (b"", "", 0, False, False, 0)
        parser = FrameParser((bytes(undecoded), *carried))
        new = {}
        for r in rows:
            if r.seq is not None and r.seq >= at and not parser.stopped:
                new.setdefault(r.seq, r.chunk)
        before = self.waiting.exists()
        while not parser.stopped:
            if at in new:
                chunk = new.pop(at)
            elif before and self.waiting.containsKey((at,)):
                chunk = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
            else:
                break
            for f in parser.feed(bytes(chunk) if chunk is not None else b""):
                yield Row(**{self.key: key[0]}, **f._asdict())
            at += 1
        if parser.stopped:
            self.waiting.clear()
        else:
            for seq, chunk in new.items():
                self.waiting.updateValue((seq,), (chunk,))
        self.carried.update((*parser.state(), at))

    def close(self) -> None:
        pass


def frame_stream(stream: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, frame_no, event, payload, problem) of a stream of (key, seq, chunk), seq gapless from 0 in each.

    The same frames as :func:`chunked_frames`, sent as soon as they are whole; what follows a ``problem`` is dropped.
    """
    keyed_state(stream.sparkSession)
    rows = stream.select(key, F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"))
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), *_OUT.fields])
    return rows.groupBy(key).transformWithState(FrameProcessor(key), out, "append", "none")

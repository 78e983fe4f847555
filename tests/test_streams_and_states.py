"""Keyed chat states, frames from chunks, the store of session states, and states folded from events."""

import json
import os
import random
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from lectern.operators import chat, review, session_states
from lectern.sources.state_store import COMPACT, Conflict, StateStore
from lectern.streaming import chat_stream, events, frames, log_store
from lectern.streaming.frames import FrameParser

ROWS = "message_id string, seq long, kind string, delta string, timestamp long"

# --- chat --------------------------------------------------------------------------------------------


def message(name, deltas, end=("complete", None), at=5):
    rows = [(name, -1, "start", None, at), *((name, k, "delta", d, at) for k, d in enumerate(deltas))]
    return rows + ([(name, len(deltas), *end, at + 1)] if end else [])


def sent(rows):
    """The events of whole messages, by a plain loop."""
    out = []
    for name in dict.fromkeys(r[0] for r in rows):
        said = ""
        for _, seq, kind, delta, at in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            if kind == "start":
                out.append((name, seq, "chat_start", {"message_id": name, "timestamp": at}))
            elif kind == "delta" and delta:
                said += delta
                out.append((name, seq, "chat_delta", {"message_id": name, "delta": delta}))
            elif kind == "complete":
                out.append((name, chat_stream.END, "chat_complete", {"message_id": name, "response": said, "timestamp": at}))
            elif kind == "error":
                out.append((name, chat_stream.END, "error", {"message_id": name, "error": delta}))
            if kind in ("complete", "gone", "error"):
                break
    return sorted(out, key=str)


def got(spark, folder):
    return sorted(((r.message_id, r.seq, r.event, json.loads(r.data)) for r in events.events_of(spark, folder).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return (
        message("a", ["He", "", "llo", None, " \n\"é😀"]) + message("b", ["x"] * 40) + message("c", [], ("error", "died")) + message("d", ["p", "q"], ("gone", None)) + message("e", [])
        + message("f", [str(rng.random()) for _ in range(25)]) + [("f", 27, "delta", "past the end", 9), ("f", 28, "complete", None, 9), ("b", None, "delta", "nowhere", 1)]
    )


def _write(spark, rows, folder):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def test_messages_across_restarts(spark, tmp_path, rows):
    """Rows in any order, with repeats, over three runs of the query: the same events, each once."""
    dealt = rows + rows[5:20]
    random.Random(0).shuffle(dealt)
    want = sent([r for r in rows if r[1] is not None])
    for k in range(3):
        _write(spark, dealt[k::3], f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        events.chat_sink(stream, f"{tmp_path}/out", once=True).awaitTermination()
        if k == 0:
            assert len(got(spark, f"{tmp_path}/out")) < len(want)
    assert got(spark, f"{tmp_path}/out") == want


def test_work_follows_the_batch(monkeypatch):
    """A new row of a long message reads none of the pieces so far."""

    class State:
        def __init__(self, value=None):
            self.value, self.reads = value, 0

        def exists(self):
            return bool(self.value)

        def get(self):
            self.reads += 1
            return self.value if isinstance(self.value, tuple) else iter(self.value or [])

        def update(self, value):
            self.value = value

        def appendList(self, values):
            self.value = [*(self.value or []), *values]

        def clear(self):
            self.value = None

    class Handle:
        def getValueState(self, *_):
            return State()

        getListState = getMapState = getValueState
        deleteTimer = registerTimer = lambda *_: None

    class Clock:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    from pyspark.sql import Row

    own = chat_stream.ChatProcessor(-1, 1000)
    own.init(Handle())
    for m, seq, kind, delta, at in message("m", ["x"] * 500):
        assert own.parts.reads == 0
        out = list(own.handleInputRows(("m",), iter([Row(seq=seq, kind=kind, delta=delta, timestamp=at)]), Clock))
        assert len(out) == 1
    assert own.parts.reads == 1 and json.loads(out[0].data)["response"] == "x" * 500 and own.parts.value is None


class Store:
    """State of one key that counts what it is asked."""

    def __init__(self):
        self.value, self.list, self.map, self.timers, self.calls, self.now = None, [], {}, set(), 0, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return getattr(self, f"_{name}")(*args)

        return call if not name.startswith("_") else object.__getattribute__(self, name)

    def getValueState(self, *_):
        return self._Part(self, "value")

    def getListState(self, *_):
        return self._Part(self, "list")

    def getMapState(self, *_):
        return self._Part(self, "map")

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def _registerTimer(self, at):
        self.timers.add(at)

    def _deleteTimer(self, at):
        self.timers.discard(at)

    class _Part:
        def __init__(self, store, name):
            self.store, self.name = store, name

        def __getattr__(self, call):
            self.store.calls += 1
            held = getattr(self.store, self.name)
            put = lambda x: setattr(self.store, self.name, x)
            return {
                "exists": lambda: bool(held), "get": lambda: iter(list(held)) if self.name == "list" else held, "update": put, "clear": lambda: put({"value": None, "list": [], "map": {}}[self.name]),
                "appendList": lambda xs: held.extend(xs), "getValue": lambda k: held.get(k), "updateValue": lambda k, v: held.__setitem__(k, v), "containsKey": lambda k: k in held, "removeKey": lambda k: held.pop(k),
            }[call]


def kept(silence=300):
    store = Store()
    own = chat_stream.ChatProcessor(-1, 1000 * silence)
    own.init(store)
    return store, own


def fed(store, own, rows):
    from pyspark.sql import Row

    out = own.handleInputRows(("m",), iter([Row(seq=seq, kind=kind, delta=delta, timestamp=at) for _, seq, kind, delta, at in rows]), store)
    return [(r.message_id, r.seq, r.event, json.loads(r.data)) for r in out]


def test_a_batch_asks_the_state_little():
    """Whatever order a short message comes in: its state is read once a batch and written once."""
    rows = message("m", ["x" * 60] * 30)
    random.Random(1).shuffle(rows)
    store, own = kept()
    store.calls, out = 0, []
    for k in range(4):
        out += fed(store, own, rows[k::4])
    assert sorted(out, key=str) == sent(rows)
    assert store.calls <= 4 * 2 + 1


@pytest.mark.parametrize("size,cuts", [(1, 7), (200, 60), (3000, 5)])
def test_long_messages_in_any_order(size, cuts):
    """Rows that outgrow the short state wait in blocks, with repeats, and nothing stays after the end."""
    rng = random.Random(size)
    whole = message("m", [chr(97 + k % 26) * size for k in range(700)])
    rows = whole + rng.sample(whole, 50)
    rng.shuffle(rows)
    store, own = kept()
    out, most = [], 0
    for k in range(cuts):
        out += fed(store, own, rows[k::cuts])
        most = max(most, len(store.map))
    assert sorted(out, key=str) == sent(whole)
    assert most > 3 and not store.map and not store.list


def test_timers_move_when_they_are_due():
    store, own = kept(300)
    rows = message("m", ["a", "b", "c"])
    fed(store, own, rows[:2])
    store.now = 200_000
    fed(store, own, rows[2:3])
    assert store.timers == {300_000}
    due = lambda: list(own.handleExpiredTimer(("m",), store, None))
    store.now = 350_000
    assert due() == [] and store.timers == {300_000, 500_000}
    store.now = 500_000
    (end,) = due()
    assert end.event == "error" and fed(store, own, rows[3:]) == []
    store.now = 900_000
    assert due() == [] and store.value is None


def test_recorded_rows_have_no_silence(spark, monkeypatch):
    """Micro-batches of recorded rows may be as far apart as a large table makes them."""
    import lectern.plans.queries as plans

    asked = []
    monkeypatch.setattr(events, "chat_stream", lambda stream, **options: asked.append(options) or chat_stream.chat_stream(stream, **options))
    assert plans.chat_stream_events(spark, "/root/testdata/sf0.001").count() > 0
    assert asked[0]["silence"] > 86_400


def test_a_silent_message_ends(spark, tmp_path):
    _write(spark, message("quiet", ["x"], None) + message("done", ["y"]) + [("gap", 3, "complete", None, 1)], f"{tmp_path}/in")
    stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
    query = chat_stream.chat_stream(stream, silence=2).writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime=events.POLL).start()
    try:
        until = time.time() + 90
        while spark.table("silent").count() < 7 and time.time() < until:
            time.sleep(0.5)
        found = Counter((r.message_id, r.event) for r in spark.table("silent").collect())
        assert found == Counter([("quiet", "chat_start"), ("quiet", "chat_delta"), ("quiet", "error"), ("done", "chat_start"), ("done", "chat_delta"), ("done", "chat_complete"), ("gap", "error")])
    finally:
        query.stop()


# --- frames ------------------------------------------------------------------------------------------

HEAD = "﻿event: chat_start\r\ndata: {\"a\":\"é😀\"}\r\n\r\n: c\r\r\rdata: [1,\ndata:　 2]\n\r\nevent:x\n\n\n\n\nid: 3\ndata: null\n\n".encode()
TAILS = [b"", b"data: 1\n\n", b"data: 1 2\n\ndata: 3\n\n", b"event: error\ndata: {}\n\n", b'event: error\ndata: {"error": "gone"}\n\ndata: 5\n\n', b'data: "\xc3\n\r\r', b'data: "\xc3', b"data: NaN\n\ndata: 1\n\n", b"data: " + b"[" * 100_000 + b"\n\n"]


def parsed(whole, cuts=(), carried=False):
    parser, out, at = FrameParser(), [], 0
    for to in [*sorted(cuts), len(whole)]:
        out += parser.feed(whole[at:to])
        at = to
        if carried:
            parser = FrameParser(parser.state())
    return out + list(parser.feed(b"", last=True))


@pytest.mark.parametrize("tail", TAILS)
def test_any_cut_gives_equal_frames(tail):
    whole = HEAD + tail
    want = parsed(whole)
    assert [(f.frame_no, f.event, f.payload) for f in want[:3]] == [(0, "chat_start", '{"a":"\\u00e9\\ud83d\\ude00"}'), (2, "message", "[1,2]"), (5, "message", "null")]
    rng = random.Random(len(tail))
    for cuts in [[k] for k in range(min(len(whole), 200))] + [rng.choices(range(len(whole)), k=rng.randrange(1, 40)) for _ in range(300)]:
        assert parsed(whole, cuts) == parsed(whole, cuts, carried=True) == want


def test_a_client_stops():
    problems = [parsed(HEAD + t)[-1].problem for t in TAILS]
    assert problems == [None, None, "Failed to parse stream payload", "Stream error occurred", "gone", "Failed to parse stream payload", None, "Failed to parse stream payload", "Failed to parse stream payload"]
    for said, shown in (('{"error": ""}', "Stream error occurred"), ('{"error": 0}', "Stream error occurred"), ('{"error": {"a": 1}}', '{"a":1}'), ("[1]", "Stream error occurred"), ("null", "Stream error occurred")):
        assert parsed(f"event: error\ndata: {said}\n\n".encode())[-1].problem == shown


def _chunks(rng):
    out = []
    for k, tail in enumerate(TAILS):
        whole, at, seq = HEAD + tail, 0, 0
        while at < len(whole):
            n = rng.randrange(0, 30) if len(whole) < 10_000 else 9_000
            out.append((None if k == 3 else k, seq, whole[at : at + n] if n else None))
            at, seq = at + n, seq + 1
    rng.shuffle(out)
    return out


def _want():
    return sorted(((None if k == 3 else k, *f) for k, t in enumerate(TAILS) for f in parsed(HEAD + t)), key=str)


def test_frames_of_tables(spark):
    table = spark.createDataFrame(_chunks(random.Random(4)), "key long, at long, chunk binary").repartition(4)
    assert sorted(map(tuple, frames.chunked_frames(table, "key", "at", "chunk").collect()), key=str) == _want()
    assert frames.chunked_frames(table.limit(0), "key", "at", "chunk").count() == 0


def test_frames_of_streams(spark, tmp_path):
    dealt = [r for r in _chunks(random.Random(5)) if r[0] is not None]
    schema = "stream_id long, seq long, chunk binary"
    for k in range(3):
        spark.createDataFrame(dealt[k::3] + dealt[:3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.event_sink(frames.frame_stream(stream), lambda x: x, f"{tmp_path}/out", once=True).awaitTermination()
    found = events.events_of(spark, f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, found.collect()), key=str) == [r for r in _want() if r[0] is not None]


def test_whole_streams_stop_too(spark):
    bodies = [(k, (HEAD + t).decode("utf-8", "replace").removeprefix("﻿")) for k, t in enumerate(TAILS[:5])]
    found = chat.stream_frames(spark.createDataFrame(bodies, "k long, body string"), "k", "body").collect()
    assert sorted((r.k, r.event, r.payload, r.problem) for r in found if r.problem) == sorted((k, f.event, f.payload, f.problem) for k, t in enumerate(TAILS[:5]) for f in parsed(HEAD + t) if f.problem)
    assert Counter(r.k for r in found) == Counter({k: len(parsed(HEAD + t)) for k, t in enumerate(TAILS[:5])})


# --- store -------------------------------------------------------------------------------------------

OTHER = """
import os, sys
from pyspark.sql import SparkSession
from lectern.operators import review
from lectern.sources.state_store import StateStore
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
store = StateStore(spark, sys.argv[1], "t")
found = spark.createDataFrame([(1, "PASS"), (2, "FAIL"), (3, "PASS")], "t int, status string")
review.pause(found, store, "verdicts")
# a second job is killed before it publishes
found.selectExpr("t", "'LOST' AS status", "'x' AS state", "'y' AS route").write.parquet(sys.argv[1] + "/parts/000000000002-lost")
open(sys.argv[1].removeprefix("file:") + "/manifests/.draft", "w").write('{"version": 2')
os._exit(3)
"""


def states(store, *columns):
    return sorted(tuple(r[c] for c in columns) for r in store.read().collect())


def test_sessions_are_resumed_by_another_application(spark, tmp_path):
    folder = f"file:{tmp_path}/store"
    root = str(Path(__file__).resolve().parent.parent)
    ended = subprocess.run([sys.executable, "-c", OTHER, folder], env=os.environ | {"PYTHONPATH": root}, capture_output=True, timeout=200)
    assert ended.returncode == 3, ended.stderr.decode()[-2000:]
    store = StateStore(spark, folder, "t")
    assert store.versions() == [1] and states(store, "t", "status", "state") == [(1, "PASS", "awaiting_review"), (2, "FAIL", "awaiting_review"), (3, "PASS", "awaiting_review")]
    reviews = spark.createDataFrame([(1, "generate_gamma"), (1, "chat_only"), (2, "chat_only"), (9, "chat_only")], "t int, action string")
    want = [(1, "complete", "presentation"), (2, "complete", "end"), (3, "awaiting_review", None)]
    for _ in range(2):  # run again, it changes nothing
        review.resume_stored(store, reviews, "monday")
        assert store.versions() == [1, 2] and sorted(states(store, "t", "state", "route"), key=str) == want
    review.resume_stored(store, spark.createDataFrame([(1, "chat_only"), (3, "generate_gamma")], "t int, action string"), "tuesday")
    assert states(store, "t", "route") == [(1, "presentation"), (2, "end"), (3, "presentation")]
    assert [r.route for r in store.read(1).collect()] == [None] * 3
    assert store.vacuum() == ["000000000002-lost"] and states(store, "t", "route") == [(1, "presentation"), (2, "end"), (3, "presentation")]


def test_versions(spark, tmp_path):
    store = StateStore(spark, f"file:{tmp_path}/s", "k")
    assert store.read() is None and store.versions() == []
    with pytest.raises(LookupError):
        review.resume_stored(store, spark.createDataFrame([], "k long, action string"), "x")
    want = {}
    for n in range(COMPACT + 4):
        rows = {k: n for k in range(n % 3, 10 + n, 2)} | {None: n}
        want |= rows
        assert store.publish(spark.createDataFrame([(v, k) for k, v in rows.items()], "v long, k long"), f"job {n}") == n + 1
        assert {r.k: r.v for r in store.read().collect()} == want and len(store.latest()["parts"]) <= COMPACT
    assert store.publish(spark.createDataFrame([(0, 0)], "v long, k long"), "job 3") == 4 and {r.k: r.v for r in store.read().collect()} == want
    assert len(store.vacuum(keep=1)) == COMPACT and {r.k: r.v for r in store.read().collect()} == want


def test_the_faster_writer_wins(spark, tmp_path, monkeypatch):
    store, other = (StateStore(spark, f"file:{tmp_path}/s", "k") for _ in range(2))
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    store.publish(rows("a"), "1")
    seen = other.latest()
    store.publish(rows("b"), "2")
    monkeypatch.setattr(other, "latest", lambda: seen)
    with pytest.raises(Conflict):
        other.publish(rows("c"), "3")
    assert [r.v for r in store.read().collect()] == ["b"] and store.versions() == [1, 2]
    assert not [n for n in os.listdir(tmp_path / "s" / "manifests") if n.startswith(".") and not n.endswith(".crc")]


# --- states from events ------------------------------------------------------------------------------


def _after(kinds):
    state, session, connected = "idle", False, False
    for k in kinds:
        if k == "upload":
            state = "uploading"
        elif k == "uploaded":
            state, session, connected = "thinking", True, True
        elif k == "upload_failed":
            state = "idle"
        elif k == "verdict" and connected:
            state = "verdict"
        elif k == "stream_complete":
            connected = False
        elif k == "stream_error" and connected:
            state, connected = "idle", False
        elif k == "generate" and session:
            state = "generating"
        elif k in ("generated", "declined") and session:
            state = "complete"
        elif k == "generate_failed" and session:
            state = "verdict"
        elif k == "reset":
            state, session, connected = "idle", False, False
    return state, session, connected


@pytest.mark.parametrize("spans,step", [(2, 1), (1, 1), (0, 1), (2, 700), (3, 5)])
def test_states_are_folded_in_order(spark, spans, step):
    rng = random.Random(spans + step)
    kinds = [*session_states.KINDS, "thinking_log", None]
    sessions = {s: [rng.choice(kinds) for _ in range(rng.choice((0, 1, 3, 3000)))] for s in [*range(12), None]}
    rows = [(s, k * step - 500, kind, 1) for s, own in sessions.items() for k, kind in enumerate(own)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "session long, seq long, kind string, map int").repartition(5)
    found = {r.session: (r.n_events, r.state, r.has_session, r.connected) for r in session_states.session_states(table, "session", "seq", "kind", spans).collect()}
    assert found == {s: (len(own), *_after(own)) for s, own in sessions.items() if own}


def test_maps_compose():
    rng = random.Random(8)
    for _ in range(200):
        kinds = rng.choices(session_states.KINDS, k=rng.randrange(9))
        done = session_states.LETTERS
        for k in kinds:
            done = done.translate(str.maketrans(session_states.LETTERS, session_states.MAPS[k]))
        assert session_states.FULL[session_states.LETTERS.index(done[session_states.START])] == _after(kinds)


def test_no_events(spark):
    assert session_states.session_states(spark.createDataFrame([], "s long, q long, k string"), "s", "q", "k").count() == 0


def test_chat_events_in_one_row_each(spark):
    """A stream's events are those of the batch operator."""
    rows = [("m", 0, "x"), ("m", 1, ""), ("m", 2, "y")]
    ends = spark.createDataFrame([("m", 5, 6, False, None)], "message string, started long, ended long, disconnected boolean, error string")
    batch = chat.chat_events(spark.createDataFrame(rows, "message string, seq long, delta string"), ends, "message", "seq", "delta")
    assert sorted(((r.message, r.seq, r.event, json.loads(r.data)) for r in batch.where(F.col("seq") >= 0).collect()), key=str) == [r for r in sent(message("m", ["x", "", "y"])) if r[1] >= 0]


# --- replay ------------------------------------------------------------------------------------------


def test_replay_reads_the_files_behind_the_offset(spark, tmp_path):
    rows = [(s, k, f"m{k}") for s in range(10) for k in range(30 if s != 4 else 2000)] + [(None, 1, "x")]
    random.Random(3).shuffle(rows)
    logs = spark.createDataFrame(rows, "session long, seq long, text string")
    log_store.write_logs(logs, f"{tmp_path}/s", "session", "seq", files=40)
    files = len(spark.read.parquet(f"{tmp_path}/s/logs").inputFiles())
    assert files > 20
    for session, after in ((4, -1), (4, 999), (4, 1998), (4, 1999), (0, -1), (9, 20), (77, -1)):
        found = log_store.replay(spark, f"{tmp_path}/s", session, after)
        assert sorted(r.seq for r in found.collect()) == sorted(k for s, k, _ in rows if s == session and k > after)
        read = len(found.inputFiles())
        assert read <= {(4, 999): 0.6, (4, 1998): 0.15, (9, 20): 0.15, (0, -1): 0.15}.get((session, after), 1) * files
    assert len(log_store.replay(spark, f"{tmp_path}/s", 4, 1999).inputFiles()) <= 1


def test_replay_of_many_clients(spark, tmp_path):
    rows = [(s, k, 0) for s in range(6) for k in range(300)]
    log_store.write_logs(spark.createDataFrame(rows, "session long, seq long, after int"), f"{tmp_path}/s", "session", "seq", files=60)
    clients = [(0, 290), (0, 295), (1, None), (2, 299), (3, 100), (9, 5), (None, 1)]
    found = log_store.replay_all(spark, f"{tmp_path}/s", spark.createDataFrame(clients, "session long, after long"))
    want = Counter((s, k) for c, a in clients for s, k, _ in rows if s == c and (a is None or k > a))
    assert Counter((r.session, r.seq) for r in found.collect()) == want
    assert len(found.inputFiles()) < 60
    everyone = spark.createDataFrame([(s, 999) for s in range(6)], "session long, after long")
    assert log_store.replay_all(spark, f"{tmp_path}/s", everyone).count() == 0

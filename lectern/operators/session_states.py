"""The front end's state after a session's events, folded without any session being sorted in one task.

What an event does is a map of states to states. Maps compose, and composition is associative: so the
events of a bounded span of ``seq`` are folded into one map, spans into maps of larger spans, and at last
into that of the session. A map is a string with a letter a state, and ``translate`` applies one to another.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("idle", "uploading", "thinking", "verdict", "generating", "complete")
#: A state with whether there is a session, and whether its event stream is open.
FULL = tuple(product(STATES, (False, True), (False, True)))
LETTERS = "".join(chr(97 + k) for k in range(len(FULL)))
START = FULL.index(("idle", False, False))
#: Bits of ``seq`` that a level folds.
SPAN = 10


def _steps(kind: str, state: str, session: bool, connected: bool) -> tuple[str, bool, bool]:
    """What an event of a kind makes of a state."""
    match kind:
        case "upload":
            return "uploading", session, connected
        case "uploaded":  # the stream of the new session is opened
            return "thinking", True, True
        case "upload_failed":
            return "idle", session, connected
        case "verdict" if connected:
            return "verdict", session, connected
        case "stream_complete":
            return state, session, False
        case "stream_error" if connected:
            return "idle", session, False
        case "generate" if session:
            return "generating", session, connected
        case "generated" | "declined" if session:
            return "complete", session, connected
        case "generate_failed" if session:
            return "verdict", session, connected
        case "reset":
            return "idle", False, False
        case _:  # logs, links, failed declines, and what needs a session or a stream that isn't there
            return state, session, connected


KINDS = ("upload", "uploaded", "upload_failed", "verdict", "stream_complete", "stream_error", "generate", "generated", "generate_failed", "declined", "reset")
#: Each kind's map: the letter at a state's place is the state that follows it.
MAPS = {kind: "".join(LETTERS[FULL.index(_steps(kind, *s))] for s in FULL) for kind in KINDS}


def transition(kind: Column) -> Column:
    """The map of an event; kinds that change nothing, and null, have the identity."""
    maps = F.create_map(*[F.lit(x) for pair in MAPS.items() for x in pair])
    return F.coalesce(F.try_element_at(maps, kind), F.lit(LETTERS))


def _folded(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The composed map of each group, its maps in the order of ``seq``."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "map", "n")))
    fold = F.aggregate("rows", F.lit(LETTERS), lambda done, r: F.call_function("translate", done, F.lit(LETTERS), r["map"]))
    return maps.groupBy(*keys).agg(rows.alias("rows"), F.sum("n").alias("n")).select(*keys, fold.alias("map"), "n")


def session_states(events: DataFrame, session: str, order: str, kind: str, spans: int = 2) -> DataFrame:
    """(session, n_events, state, has_session, connected): the state that each session's events lead to, from idle on.

    ``order`` is a bigint, dense or nearly so; ``kind`` one of ``KINDS``, anything else changes nothing. Rows of
    equal place are folded in the order of their maps. A null session is a session; events without a place
    come first. ``spans`` levels of 2**SPAN places are folded before the whole session: a task holds the
    maps of a span of places, or one map for each 2**(SPAN * spans) places of a session.
    """
    maps = events.select(F.col(session).alias("session"), F.col(order).cast("long").alias("seq"), transition(F.col(kind)).alias("map"), F.lit(1).cast("long").alias("n"))
    for _ in range(spans):
        spanned = maps.withColumn("span", F.shiftright("seq", SPAN))
        maps = _folded(spanned, ["session", "span"]).withColumnRenamed("span", "seq")
    done = _folded(maps, ["session"])
    last = F.substring("map", START + 1, 1)
    facts = F.create_map(*[x for k, (state, has, open_) in enumerate(FULL) for x in (F.lit(LETTERS[k]), F.struct(F.lit(state).alias("state"), F.lit(has).alias("has_session"), F.lit(open_).alias("connected")))])
    found = done.select("session", F.col("n").alias("n_events"), facts[last].alias("facts"))
    return found.select(F.col("session").alias(session), "n_events", "facts.*")

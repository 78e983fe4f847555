"""The human's part: pause after the verdict, decision, resume, and what the front end shows and does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.sources.state_store import StateStore

# Fixed values
GENERATE, AWAITING, DONE = "generate_gamma", "awaiting_review", "complete"


def pause(found: DataFrame, store: StateStore, token: str) -> DataFrame:
    """Publishes verdicts as states that await review, with no ``route`` yet, and returns all states.

    They outlive the application: any later one goes on from ``store``. A job that is run again with its
    ``token`` changes nothing.
    """
    store.publish(found.withColumns({"state": F.lit(AWAITING), "route": F.lit(None).cast("string")}), token)
    return store.read()


def wants_presentation(action: Column) -> Column:
    return F.coalesce(action == GENERATE, F.lit(False))


def resume(awaiting: DataFrame, reviews: DataFrame, thread: str) -> DataFrame:
    """Checkpointed sessions with their decisions (thread, action): ``state`` and ``route``.

    A decision to generate routes to the presentation, any other ends the session; without a decision a
    session goes on waiting and has no route. Of several decisions for one session the presentation counts.
    """
    decided = reviews.groupBy(thread).agg(F.max(wants_presentation(F.col("action"))).alias("generate"))
    joined = awaiting.join(decided, thread, "left")
    route = F.when(F.col("generate"), "presentation").when(~F.col("generate"), "end")
    return joined.withColumn("route", route).withColumn("state", F.when(F.col("generate").isNull(), F.col("state")).otherwise(DONE)).drop("generate")


def resume_stored(store: StateStore, reviews: DataFrame, token: str) -> DataFrame:
    """Resumes stored sessions with their decisions (key, action), publishes those that went on, and returns all states.

    Sessions that are over stay as they are. With nothing stored that is an error.
    """
    states = store.read()
    if states is None:
        raise LookupError("no session awaits a review in this store")
    decided = resume(states.where(F.col("state") == AWAITING).drop("route"), reviews, store.key)
    store.publish(decided.where(F.col("route").isNotNull()), token)
    return store.read()


def review_responses(resumed: DataFrame, thread: str, links: DataFrame | None = None) -> DataFrame:
    """(thread, status, link) of every decided session; a link only where a presentation was made (thread, link)."""
    done = resumed.where(F.col("route").isNotNull())
    made = done.withColumn("link", F.lit(None).cast("string")) if links is None else done.join(links, thread, "left")
    return made.select(thread, F.lit(DONE).alias("status"), F.when(F.col("route") == "presentation", F.nullif("link", F.lit(""))).alias("link"))


def snapshot(states: DataFrame, thread: str, wanted: DataFrame) -> DataFrame:
    """The checkpointed state of each wanted session; one without has a null state."""
    return wanted.select(thread).join(states, thread, "left")


def ui_state(uploading: Column, has_thread: Column, has_verdict: Column, generating: Column, reviewed: Column, failed: Column) -> Column:
    """What the front end is in: idle, uploading, thinking, verdict, generating or complete.

    An error before the verdict goes back to idle, one while generating back to the verdict.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    verdict = F.when(yes(reviewed), "complete").when(yes(generating) & ~yes(failed), "generating").otherwise("verdict")
    return F.when(yes(has_verdict), verdict).when(yes(failed), "idle").when(yes(has_thread), "thinking").when(yes(uploading), "uploading").otherwise("idle")


def send_route(n_pending: Column, state: Column, message: Column) -> Column:
    """What sending does: upload pending files, chat once there is a verdict, remind while idle, else nothing."""
    said = strip(F.coalesce(message, F.lit(""))) != ""
    return F.when(n_pending > 0, "upload").when(state.isin("verdict", "generating", "complete") & said, "chat").when((state == "idle") & said, "remind").otherwise("none")

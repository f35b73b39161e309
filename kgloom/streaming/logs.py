"""Append-only logs as streams: review queue, decisions, windowed counts and orphan tracking.

Each stream is a function from a streaming frame to a started query or a streaming frame, and agrees with its batch twin once all
input is processed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decisions
from ..operators.orphans import OrphanState
from ..sources.sinks import append_new


def review_queue(events: DataFrame) -> DataFrame:
    """First flag of each concept and reason over all history: the state keeps one entry per pair, without expiry."""
    own = events.where("event_type is not null").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("concept_id"), F.col("event_type").alias("reason"))
    return own.dropDuplicates(["concept_id", "reason"])


def decisions_to(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Decisions of new events appended to the table at ``path``; a batch that is run again appends nothing twice."""
    return events.writeStream.foreachBatch(lambda df, _: append_new(decisions.from_events(df), path, ["id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Events and their value per hour and type; in a stream, events later than ``late`` behind the newest are dropped."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        own = own.withWatermark("ts", late)
    return own.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def track_orphans(events: DataFrame, state: OrphanState, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Batches of references and parents into an :class:`OrphanState`; ``split`` takes a batch to (references, parents).

    The state lies in its own folder and keeps the number of the last batch: a restarted stream goes on with a state of the same path,
    and a batch that is run again changes nothing.  A new checkpoint numbers batches from 0, so it needs a new state.
    """

    def advance(df: DataFrame, batch: int) -> None:
        df.persist()
        state.advance(*split(df), batch=batch)
        df.unpersist()

    return events.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Log and message streams. Each operator takes a batch or a stream where that is said."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RING, CLOSED = 1000, ("closed", "failed")


def ring(events: DataFrame, size: int = RING, by: str = "source", at: str = "ts", tie: str = "id") -> DataFrame:
    """Batch: of each source the last ``size`` events; the rank filter is a group limit below the shuffle."""
    w = W.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


class RingState(StatefulProcessor):
    """Keeps the last events of a key and passes on what a batch leaves in the ring."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "id long, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        new = sorted(tuple(r) for part in rows for r in part[["id", "message"]].itertuples(index=False))
        now = [*old, *new][-self.size :]
        self.kept.put([(int(i), m) for i, m in now])
        yield pd.DataFrame({"source": [key[0]] * len(now), "id": [i for i, _ in now], "message": [m for _, m in now]})

    def close(self) -> None:
        pass


def ring_stream(events: DataFrame, size: int = RING) -> DataFrame:
    """Stream (source, id, message): after each batch, the ring of each source that got events."""
    return events.groupBy("source").transformWithStateInPandas(RingState(size), "source string, id long, message string", "Update", "None")


def subscribed(events: DataFrame, sources: list[str], known: DataFrame | None = None) -> DataFrame:
    """Batch or stream: events of the named sources; a name that ``known`` (source) lacks is an error."""
    if known is not None:
        have = {r[0] for r in known.where(F.col("source").isin(sources)).select("source").distinct().collect()}
        if gone := sorted(set(sources) - have):
            raise KeyError(f"no such source: {', '.join(gone)}")
    return events.where(F.col("source").isin(sources))


def replay_then_follow(past: DataFrame, live: DataFrame) -> DataFrame:
    """Batch: buffered events first, then live ones that aren't among them, in order of id."""
    fresh = live.join(past.select("id"), "id", "left_anti")
    return past.withColumn("phase", F.lit(0)).unionByName(fresh.withColumn("phase", F.lit(1))).orderBy("phase", "id")


def all_reached(events: DataFrame, sources: list[str], target: str) -> DataFrame:
    """One row: whether the sources that reached the target or an end are just those asked for."""
    ended = events.where(F.col("state").isin(*CLOSED, target)).where(F.col("source").isin(sources))
    return ended.agg((F.countDistinct("source") == len(set(sources))).alias("done"))


def envelope(data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("data: "), data, F.lit("\n\n"))


def enveloped(events: DataFrame, data: str, order: str, error: Column | None = None) -> DataFrame:
    """(place, line): events in order, errors after all others, then the end mark."""
    bad = F.lit(False) if error is None else error
    body = events.select(F.when(bad, 1).otherwise(0).alias("place"), F.col(order).cast("long").alias("at"), envelope(F.col(data)).alias("line"))
    end = events.sparkSession.range(1).select(F.lit(2).alias("place"), F.lit(0).cast("long").alias("at"), envelope(F.lit("[DONE]")).alias("line"))
    return body.unionByName(end)


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """Batch, chunks (id, pos, text, finished): by id the texts in order, of those that have finished."""
    g = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("c"), F.max("finished").alias("f"))
    return g.where("f").select("id", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))


def route(kind: Column, message: Column) -> Column:
    """The output type of an event, by its stream mode and the message in it."""
    return (
        F.when(kind == "messages", F.when(message == "tool", "tool_result").when(message == "reasoning", "reasoning").otherwise("text"))
        .when(kind == "values", F.when(message == "user", "message_info").otherwise("interrupted"))
        .when(kind == "updates", "tool_calls")
        .when(kind == "custom", "progress")
        .otherwise("error")
    )


def tumbling(events: DataFrame, width: str = "10 minutes", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Batch or stream (an extension): counts by window and type; rows later than ``late`` may be left out of a stream."""
    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return e.groupBy(F.window("_at", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Batch or stream (an extension): sessions of users."""
    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return e.groupBy(F.session_window("_at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

"""Incremental maintenance of a search table from a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators.store import last_wins


def applied(index: DataFrame, changes: DataFrame) -> DataFrame:
    """index (id, chat_id, title, content) after changes (seq, op, id, chat_id, title, content): the last change of an id counts;
    op delete takes it out. A title that changes (op title, by chat) is set in all rows of its chat that are left."""
    rows = last_wins(changes.where("op <> 'title'"), "id", order="seq")
    kept = index.join(rows.select("id"), "id", "left_anti")
    now = kept.unionByName(rows.where("op <> 'delete'").select(*index.columns))
    titles = changes.where("op = 'title'").groupBy("chat_id").agg(F.max_by("title", "seq").alias("_t"))
    return now.join(titles, "chat_id", "left").withColumn("title", F.coalesce("_t", "title")).select(*index.columns)


def maintain(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Apply each batch of a stream of changes to the index that ``read`` gives and ``write`` replaces."""
    return changes.writeStream.foreachBatch(lambda batch, _: write(applied(read(), batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """Counters of a running query: batches and rows so far in its reports."""
    reports = query.recentProgress
    return {"batches": len(reports), "rows": sum(r["numInputRows"] for r in reports), "active": query.isActive}

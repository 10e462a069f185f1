"""Conversation store: chats (id, title, created_at, starred_at, user_id) and messages (id, chat_id, created_at, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def owned_by(user: Column) -> Column:
    """Rows of a user; a null user owns the rows without one."""
    return F.col("user_id").eqNullSafe(user)


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows whose key isn't taken are added; taken keys change nothing. Of equal new keys one is added."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def delete_many(chats: DataFrame, ids: DataFrame, user: Column) -> DataFrame:
    """Chats that stay when the given ids (id) of a user are deleted."""
    mine = ids.select(F.col("id"), F.lit(True).alias("_in")).distinct()
    return chats.join(mine, "id", "left").where(~(F.coalesce("_in", F.lit(False)) & owned_by(user))).drop("_in")


def exists(chats: DataFrame, condition: Column) -> DataFrame:
    """One row: whether a chat meets the condition."""
    return chats.where(condition).limit(1).agg((F.count("*") > 0).alias("found"))


def patched(chats: DataFrame, condition: Column, now: Column, title: Column | None = None, star: bool | None = None) -> DataFrame:
    """Chats that meet the condition get a title (null: unchanged), a star or none (None: unchanged), and updated_at."""
    starred = F.col("starred_at") if star is None else now if star else F.lit(None)
    change = lambda new, old: F.when(condition, new).otherwise(old)
    named = F.col("title") if title is None else F.coalesce(title, F.col("title"))
    updated = F.col("updated_at") if "updated_at" in chats.columns else F.lit(None).cast("timestamp_ntz")
    return chats.withColumns({"title": change(named, F.col("title")), "starred_at": change(starred, F.col("starred_at")), "updated_at": change(now, updated)})


def with_files(messages: DataFrame, condition: Column, images: Column, documents: Column) -> DataFrame:
    """Messages that meet the condition get files: images, then documents, as JSON text; an empty list is ''."""
    files = F.concat(images, documents)
    text = F.when(F.size(files) > 0, F.to_json(files)).otherwise("")
    return messages.withColumn("files", F.when(condition, text).otherwise(F.col("files") if "files" in messages.columns else F.lit("")))


def last_message_times(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.max("created_at").alias("last_message_at"))


def with_activity(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with last_at: the time of their last message, or their own where they have none."""
    last = last_message_times(messages).withColumnRenamed("chat_id", "id")
    return chats.join(last, "id", "left").withColumn("last_at", F.coalesce("last_message_at", "created_at")).drop("last_message_at")


def listed(chats: DataFrame, by: str = "last_at") -> DataFrame:
    """Starred chats first, the latest star on top, then by time, latest first; nulls last; ties by id."""
    return chats.orderBy(F.desc_nulls_last("starred_at"), F.desc_nulls_last(by), "id")


def by_star(chats: DataFrame) -> DataFrame:
    return chats.withColumn("section", F.when(F.col("starred_at").isNotNull(), "starred").otherwise("normal"))


def loaded(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Each chat with its messages, as an array in order of id; [] where there are none."""
    cols = [c for c in messages.columns if c != "chat_id"]
    grouped = messages.groupBy(F.col("chat_id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in cols if c != "id"]))).alias("messages"))
    joined = chats.join(grouped, chats["id"] == grouped["_c"], "left").drop("_c")
    return joined.withColumn("messages", F.coalesce("messages", F.array().cast(joined.schema["messages"].dataType)))


def search_rows(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages with their chat's title, owner and last message time."""
    c = chats.select(F.col("id").alias("chat_id"), "title", "user_id")
    return messages.join(c, "chat_id").join(last_message_times(messages), "chat_id")


def next_reply(messages: DataFrame) -> DataFrame:
    """(id, reply_id) for each user message: the assistant's message with the smallest larger id in the chat."""
    later = W.partitionBy("chat_id").orderBy("id").rowsBetween(1, W.unboundedFollowing)
    reply = F.min(F.when(F.col("role") == "assistant", F.col("id"))).over(later)
    return messages.withColumn("reply_id", reply).where("role = 'user'").select("id", "reply_id")


def after_anchor(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Messages that go when everything after an anchor (chat_id, anchor_id) goes: those with a later time
    than the anchor's. An anchor that isn't there deletes nothing."""
    at = anchors.join(messages.select("chat_id", F.col("id").alias("anchor_id"), F.col("created_at").alias("_at")), ["chat_id", "anchor_id"])
    return messages.join(at.select("chat_id", "_at"), "chat_id").where(F.col("created_at") > F.col("_at")).drop("_at")

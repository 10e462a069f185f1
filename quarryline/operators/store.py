"""A document store as tables: change detection, upserts, deletes, caches, statistics.

A store is documents (source, ...) and chunks (source, ...); sinks return the new table, which the
caller writes to a new version of it, since a parquet table can't be changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def content_hash(content: str | Column) -> Column:
    """SHA-256 of bytes (a string counts as UTF-8), lowercase hex."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def last_wins(df: DataFrame, *keys: str, order: str | Column) -> DataFrame:
    """Of each key the row that comes last: a partial aggregate, not a sort of the key's rows."""
    cols = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order) if isinstance(order, str) else order).alias("_last"))
    return kept.select(*keys, "_last.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Rows of ``new`` replace all rows of ``old`` with their keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_batch(old: DataFrame, batch: DataFrame, order: str, key: str = "source") -> DataFrame:
    """upsert() of a batch in which a key may come several times: the last one counts."""
    return upsert(old, last_wins(batch, key, order=order), key)


def delete(df: DataFrame, gone: DataFrame, key: str = "source") -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def clear(df: DataFrame) -> DataFrame:
    """An empty table of the same columns; metadata and caches are tables of their own and stay."""
    return df.limit(0)


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``found`` (name, hash) to index: names that aren't stored, or are with another hash or
    with none. Names are base names; stored names that are no longer found stay."""
    s = stored.select(F.col("name"), F.col("hash").alias("_stored"), F.lit(True).alias("_known"))
    return found.join(s, "name", "left").where(F.col("_known").isNull() | ~F.col("hash").eqNullSafe(F.col("_stored")) | F.col("_stored").isNull()).drop("_stored", "_known")


def model_is_stale(documents: Column, stored: Column, current: Column) -> Column:
    return F.coalesce((documents > 0) & stored.isNotNull() & (stored != current), F.lit(False))


def cached(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(hash, embedding) of the texts (hash) that the cache (text_hash, model, embedding) has for the model."""
    c = cache.where(F.col("model") == model).select(F.col("text_hash").alias("hash"), "embedding")
    return texts.select("hash").distinct().join(c, "hash")


def misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Different texts (hash, text) that have to be embedded; each once, at its first position."""
    once = texts.groupBy("hash").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))
    return once.join(cache.where(F.col("model") == model).select(F.col("text_hash").alias("hash")), "hash", "left_anti")


def first_of_each(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Different values at their first position."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def stored_name(content: Column, name: Column) -> Column:
    """Name under which an upload is kept: the first 12 hex digits of its MD5, a dash, its name."""
    return F.concat(F.substring(F.md5(content), 1, 12), F.lit("-"), name)


def upload_dedup(files: DataFrame) -> DataFrame:
    """files (id, name, content) with the path each is kept under: that of the first file of the same content."""
    h = F.substring(F.md5("content"), 1, 12)
    named = files.select("id", h.alias("h"), stored_name(F.col("content"), F.col("name")).alias("own"))
    first = named.groupBy("h").agg(F.min_by("own", "id").alias("path"))
    return named.join(first, "h").select("id", "path", (F.col("own") != F.col("path")).alias("reused"))


def document_counts(chunks: DataFrame) -> DataFrame:
    """By source: the largest page and the number of chunks."""
    return chunks.groupBy("source").agg(F.max("page").alias("page_count"), F.count("*").alias("chunk_count"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """outcomes (error boolean, skipped boolean, chunks): one row of counts; documents without chunks are skipped."""
    ok = ~F.col("error") & ~F.col("skipped")
    return outcomes.agg(
        F.count_if(ok & (F.col("chunks") > 0)).alias("indexed"),
        F.count_if(~F.col("error") & (F.col("skipped") | (F.col("chunks") == 0))).alias("skipped"),
        F.count_if("error").alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("total_chunks"),
    )


def cache_key(prefix: str, path: Column) -> Column:
    """Key of an extraction cache: prefix, colon, 12 hex digits of the path's MD5."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.md5(path), 1, 12))


def live(entries: DataFrame, now: Column, ttl_seconds: int = 1800) -> DataFrame:
    """Cache entries (key, at, ...) not older than the time to live, in order of the key."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return entries.where(age <= ttl_seconds * 1_000_000).orderBy("key")


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.col(at).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

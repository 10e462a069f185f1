"""Token usage of messages and its sums by chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolled_up(usage: DataFrame, by: str = "chat_id") -> DataFrame:
    """By chat: sums of tokens, the first positive ttft in order of id, and tps as the mean over
    messages with output, weighted by it (sums of whole numbers, one division). Only chats with tokens have a row."""
    spoke = F.col("output_tokens") > 0
    g = usage.groupBy(by).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.min_by("ttft", F.when(F.col("ttft") > 0, F.struct("id", "ttft"))).alias("ttft"),
        F.sum(F.when(spoke, F.col("tps") * F.col("output_tokens"))).alias("_w"),
        F.sum(F.when(spoke, F.col("output_tokens"))).alias("_o"),
    )
    return g.where("input_tokens > 0 or output_tokens > 0").withColumn("tps", F.coalesce(F.try_divide("_w", "_o"), F.lit(0.0))).drop("_w", "_o")


def speed(output_tokens: Column, seconds: Column) -> Column:
    """Tokens a second; 0 where no time passed."""
    return F.when(seconds > 0, output_tokens / seconds).otherwise(F.lit(0.0))


def first_token_times(chunks: DataFrame) -> DataFrame:
    """chunks (stream, ts, started, content): time from the start to the first chunk with content."""
    return chunks.where(F.coalesce(F.length("content"), F.lit(0)) > 0).groupBy("stream").agg((F.min("ts") - F.min("started")).alias("ttft"))

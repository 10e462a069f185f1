"""Log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_log(rows: DataFrame, path: str, at: str = "ts") -> None:
    """JSON lines in a folder for each day."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(path)


def write_chat_log(messages: DataFrame, path: str) -> None:
    """messages (date, chat_id, text): a text file's worth of lines in a folder for each day and chat."""
    messages.select("date", "chat_id", F.col("text").alias("value")).write.mode("append").partitionBy("date", "chat_id").text(path)


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts, in the order of their columns."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

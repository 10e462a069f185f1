"""The corpus pipeline: five stages over `documents`, each on all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import decontaminate, mixing, sharding, simhash, toxicity
from quarryline.llm.common import cut

#: The hash of the toxicity split and of mixing and sharding isn't in SQL: tested against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Null and empty texts are as likely ordinary as toxic, and stay."""
    return toxicity.reject(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id; of repeated ids one row, by a total order. Null and
    empty texts are one group; rows with a null doc_id all stay."""
    return simhash.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; texts without words hold none and stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: not at all, once or twice. A null source is a source; rows that are the same in
    doc_id and text are taken alike."""
    return mixing.apply(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a place in it for each row of the mix; rows that are the same take following places, a null doc_id is a key."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next one. Texts are read whole, however long; further
    columns stay up to the last stage; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs

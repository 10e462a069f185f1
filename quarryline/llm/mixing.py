"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.llm.common import WORD, aside, cut

#: Bits of the hash that one histogram resolves, and bits of the hash in all.
STEP, BITS = 10, 60
#: Sources up to which a table of a row for each is sent to the executors (some 100 bytes a row).
BROADCAST_SOURCES = 200_000


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, total) with target, the words to take of each: ``share`` of all words by the repeating ``weights``,
    sources in code-point order and null last; what is above ``most`` times a source's size goes to the others
    by weight, until none is above. Sources without words get 0 in the end.

    Numbering them takes one task with a row for each source. The level that words are poured to, words a weight, only rises
    from round to round, so a round is a sum over the sources below it."""
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = cut(sources.withColumns({"_w": weight, "_cap": F.lit(float(most)) * F.col("total")}))
    words, open_ = rows.agg(F.sum("total"), F.sum("_w")).first()
    left, poured, full = share * (words or 0), open_ or 0.0, 0
    given = lambda: F.lit(float(left)) * F.col("_w") / F.lit(float(poured))
    while poured:
        n, cap, w = rows.where(given() > F.col("_cap")).agg(F.count("*"), F.sum("_cap"), F.sum("_w")).first()
        if n == full:
            break
        full, left, poured = n, share * words - cap, open_ - w
    target = F.when(given() > F.col("_cap"), F.col("_cap")).otherwise(given()) if poured else F.col("_cap")
    return rows.select("source", "total", target.alias("target"))


def _hashed(docs: DataFrame) -> DataFrame:
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))))
    return docs.withColumn("_ql_hash", F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return _hashed(docs).withColumn("_ql_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def _small(table: DataFrame, rows: int, most: int) -> DataFrame:
    """A table of a row for each source, to be sent to the executors where it has at most ``most`` rows; else it is joined."""
    return F.broadcast(table) if rows <= most else table


def thresholds(sized: DataFrame, weights: Sequence[float], share: float, most: float, broadcast_sources: int = BROADCAST_SOURCES) -> tuple[DataFrame, int]:
    """(_s, _ql_source_size, _ql_target, _ql_whole, _ql_limit) of each source of ``sized`` (source, _ql_size, _ql_hash), and their number."""
    totals = cut(sized.groupBy("source").agg(F.sum("_ql_size").alias("total")))
    n = totals.count()
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    sources = cut(targets(totals, weights, share, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("total")))
    #: By source: the prefix of the border bucket, the words below it, those up to it, and its own.
    border = sources.where("rest > 0").select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_below"), "rest")
    for low in range(BITS - STEP, -1, -STEP):
        here = sized["source"].eqNullSafe(F.col("_s")) & (F.shiftright("_ql_hash", low + STEP) == F.col("_p"))
        buckets = sized.join(_small(border, n, broadcast_sources), here).groupBy("_s", "_below", "rest", F.shiftright("_ql_hash", low).alias("_b")).agg(F.sum("_ql_size").alias("_words"))
        upto = F.col("_below") + F.sum("_words").over(W.partitionBy("_s").orderBy("_b"))  # at most 2 ** STEP rows a source
        bucket = F.struct("_b", "_upto", "_words")
        found = buckets.withColumn("_upto", upto).groupBy("_s", "rest").agg(F.min(F.when(F.col("_upto") > F.col("rest"), bucket)).alias("over"), F.max(bucket).alias("last"))
        found = found.select("_s", "rest", F.coalesce("over", "last").alias("x")).select("_s", "rest", F.col("x._b").alias("_p"), (F.col("x._upto") - F.col("x._words")).alias("_below"), F.col("x._upto").alias("_upto"))
        border = cut(found)
    nearer = F.abs(F.col("_upto") - F.col("rest")) < F.abs(F.col("rest") - F.col("_below"))
    limits = border.select("_s", F.when(nearer, F.col("_p")).otherwise(F.col("_p") - 1).alias("_ql_limit"))
    joined = sources.join(limits, sources["source"].eqNullSafe(limits["_s"]), "left")
    return cut(joined.select(F.col("source").alias("_s"), F.col("total").alias("_ql_source_size"), F.col("target").alias("_ql_target"), F.col("whole").alias("_ql_whole"), F.coalesce("_ql_limit", F.lit(-1)).alias("_ql_limit"))), n


def _with_copies(hashed: DataFrame, limits: DataFrame, n: int, broadcast_sources: int) -> DataFrame:
    once_more = (F.col("_ql_hash") <= F.col("_ql_limit")).cast("long")
    return hashed.join(_small(limits, n, broadcast_sources), hashed["source"].eqNullSafe(F.col("_s"))).withColumn("_ql_copies", F.col("_ql_whole") + once_more)


def report(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``.

    A document's size is its number of words (null: 0). Of a source every document is taken
    floor(target / size) times, and once more if its hash is at most the source's threshold: the
    threshold whose taken words come nearest the target, the lower one on a tie. Histograms of
    words by source and hash bucket find it, each round refining only the bucket that holds the
    border; at the end that bucket is one hash, so documents are never sorted. Rows that are the same
    in doc_id and text share a hash and are taken alike. Null sources are a source of their own. An
    empty table gives no rows; texts are counted whole, however long; further columns are ignored.

    No row is shuffled by its source: histograms are summed before they are, and tables of a row for each source are sent to the
    executors, up to ``broadcast_sources`` sources. With more, rows are joined with them instead, and hot sources are split by
    the adaptive plan. The driver gets sums over all sources only.
    """
    sized = cut(_sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_ql_size", "_ql_hash"))
    return _with_copies(sized, *thresholds(sized, weights, share, most, broadcast_sources), broadcast_sources).select(
        "doc_id",
        F.col("_ql_size").alias("size"),
        F.col("_ql_source_size").alias("source_size"),
        F.col("_ql_target").alias("target"),
        (F.col("_ql_size") * F.col("_ql_copies")).alias("taken"),
    )


def apply(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The mixed rows, all columns as they were: a document that is taken twice stands twice. See report()."""
    sized = cut(_sized(docs.select("doc_id", "source", "text")).select("source", "_ql_size", "_ql_hash"))
    limits, n = thresholds(sized, weights, share, most, broadcast_sources)

    def mixed(d: DataFrame) -> DataFrame:
        return _with_copies(_hashed(d), limits, n, broadcast_sources).where("_ql_copies > 0").withColumn("_ql_copy", F.explode(F.sequence(F.lit(1), F.col("_ql_copies"))))

    return aside(docs, mixed)

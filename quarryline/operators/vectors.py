"""Exact nearest-neighbour search over arrays of floats, as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; float arrays are widened first."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def knn(vectors: DataFrame, query: list[float], k: int, *, only: Column | DataFrame | None = None, max_distance: float | None = None) -> DataFrame:
    """The k nearest rows with their distance, ties by vec_id.

    ``only`` (a predicate, or rows with vec_id) restricts the candidates BELOW the top-k, so that near
    rows of others do not use up the k places; ``max_distance`` filters ABOVE it, and a row without a
    distance counts as distance 0.
    """
    kept = vectors
    if isinstance(only, DataFrame):
        kept = vectors.join(only.select("vec_id").distinct(), "vec_id", "left_semi")
    elif only is not None:
        kept = vectors.where(only)
    top = kept.withColumn("distance", l2(F.col("embedding"), vector(query))).orderBy("distance", "vec_id").limit(k)
    return top if max_distance is None else within(top, max_distance)


def within(hits: DataFrame, max_distance: float) -> DataFrame:
    return hits.where(F.coalesce("distance", F.lit(0.0)) <= max_distance)


#: Bytes of queries that one scan of the vectors is compared with; they are sent to the executors.
TILE_BYTES = 8 << 20


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(q, vec_id, distance, rank) of the k nearest vectors of each query (q, query), ties by vec_id.

    Exact search compares every query with every vector: queries are dealt into tiles of about ``tile_bytes`` bytes by a hash of q, and each
    tile is sent to the tasks that scan the vectors. The rank filter becomes a group limit below the shuffle, so each task
    sends k rows for each query at most.
    """
    size = queries.agg(F.sum(F.size("query") * 8 + 16)).first()[0] or 0
    tiles = -(-size // tile_bytes) or 1
    rank = F.row_number().over(W.partitionBy("q").orderBy("distance", "vec_id"))

    def nearest(tile: DataFrame) -> DataFrame:
        pairs = vectors.crossJoin(F.broadcast(tile)).select("q", "vec_id", l2(F.col("embedding"), F.col("query")).alias("distance"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [nearest(queries.where(F.pmod(F.xxhash64("q"), F.lit(tiles)) == i)) for i in range(tiles)])


def with_documents(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits joined with their chunk (vec_id, doc_id, ...) and that chunk's document (doc_id, ...): above the top-k, so k rows."""
    return hits.join(chunks, "vec_id").join(documents, "doc_id")


def relevance(distance: Column) -> Column:
    """1 - distance with two decimals; empty where there is no distance or it is 0."""
    return F.when(F.coalesce(distance, F.lit(0.0)) == 0, F.lit("")).otherwise(F.format_string("%.2f", 1 - distance))

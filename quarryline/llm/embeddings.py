"""Near-duplicate embeddings: a small-world graph for each shard, every shard asked for every vector."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import aside, components, cut
from quarryline.llm.hnsw import Hnsw
from quarryline.llm.simhash import forest

#: Shards at least, and bytes of vectors in double precision that a shard holds at most (about; they are dealt by hash).
SHARDS, SHARD_BYTES = 4, 128 << 20
#: Vectors asked for at a time, and bytes of a piece of a stored graph.
BLOCK, PIECE = 8192, 4 << 20
#: Tasks that share a shard's queries, at least where there are so many queries; beyond that as many as there are shards.
BLOCKS = 8
#: Beam to begin with; queries audited against brute force at a time in each task; mean recall of a query's links to reach.
BEAM, AUDIT, RECALL = 16, 256, 0.999
#: Audited queries that have a link to another vector, before a recall counts.
LINKED = 256
#: Similarities in single precision are this near to those in double precision.
SLACK = 1e-4


def usable(v: Column) -> Column:
    """Whether a vector can link: not null, not zero, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision. All vectors have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(t: pa.Table) -> pa.Table:
    """The graph of one shard and its vectors as they came, pickled and in pieces."""
    order = np.lexsort((t.column("rep").to_numpy(), t.column("h").to_numpy()))
    t = t.take(pa.array(order))
    vectors = t.column("embedding").combine_chunks()
    graph = Hnsw(_matrix(vectors))
    blob = pickle.dumps((vectors, graph.links, graph.level, t.column("rep").to_numpy(), t.column("mult").to_numpy()))
    pieces = [blob[i : i + PIECE] for i in range(0, len(blob), PIECE)]
    dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
    return pa.table({"dim": pa.array([dim] * len(pieces), pa.int32()), "shard": pa.array([shard] * len(pieces), pa.int32()), "piece": pa.array(range(len(pieces)), pa.int32()), "data": pa.array(pieces, pa.binary())})


def search(
    x: np.ndarray, graph: Hnsw, index: np.ndarray, least: float, own: np.ndarray | None = None, rep: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(query, row) pairs of unit vectors with a cosine of at least ``least``, the beam used and its recall: the mean,
    over audited queries with a link, of the share of their links that is found. Pairs whose ids (``own`` of the queries,
    ``rep`` of the rows) are the same are no links.

    Queries are audited by brute force until ``LINKED`` of them have a link; where that takes all of them, the audit is
    the answer. The beam doubles until the recall is reached; where a beam of a quarter of the shard doesn't reach it, all rows
    are compared, in tiles. Audited queries answer by the audit."""
    small = x.astype(np.float32)
    order = np.random.default_rng(7).permutation(len(x))
    link = lambda q, i: np.ones(len(q), bool) if own is None or rep is None else rep[i] != own[q]
    found, at, linked = [], 0, 0
    while at < len(x) and linked < LINKED:
        some = order[at : at + AUDIT]
        q, i = _compare(x, small, graph, index, some, least)
        found.append((q, i))
        linked += len(np.unique(q[link(q, i)]))
        at += len(some)
    beam = BEAM
    while at < len(x) and beam * 4 <= max(len(index), 4 * BEAM):
        audit = order[:at]
        true = np.concatenate([q[link(q, i)] for q, i in found])
        q, i = _exact(x[audit], index, *graph.within(small[audit], least - SLACK, beam), least)
        q = audit[q]
        want, have = np.bincount(true, minlength=len(x)), np.bincount(q[link(q, i)], minlength=len(x))
        recall = float((have[want > 0] / want[want > 0]).mean())
        if recall >= RECALL:
            rest = order[at:]
            q, i = _exact(x[rest], index, *graph.within(small[rest], least - SLACK, beam), least)
            found.append((rest[q], i))
            return np.concatenate([q for q, _ in found]), np.concatenate([i for _, i in found]), beam, recall
        beam *= 2
    found += [_compare(x, small, graph, index, order[a : a + AUDIT], least) for a in range(at, len(x), AUDIT)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(q for q, _ in found)]), np.concatenate([none, *(i for _, i in found)]), len(index), 1.0


def _compare(x: np.ndarray, small: np.ndarray, graph: Hnsw, index: np.ndarray, some: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, row) pairs of the queries ``some``."""
    near = np.argwhere(small[some] @ graph.x.T >= least - SLACK)
    q, i = _exact(x[some], index, near[:, 0], near[:, 1], least)
    return some[q], i


def _exact(x: np.ndarray, index: np.ndarray, q: np.ndarray, i: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    keep = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[q[a : a + 65536]], index[i[a : a + 65536]]) >= least for a in range(0, len(q), 65536))])
    return q[keep], i[keep]


def _answers(graph: Hnsw, index: np.ndarray, rep: np.ndarray, mult: np.ndarray, asked: pa.Table, least: float) -> pa.RecordBatch:
    """Counts of links (a, null, n), and the links as a forest (a, b, 0): as many edges as vertices at most."""
    own = asked.column("rep").to_numpy()
    q, i, _, _ = search(_matrix(asked.column("embedding")), graph, index, least, own, rep)
    other = rep[i] != own[q]
    q, i = q[other], i[other]
    n = np.bincount(q, weights=mult[i], minlength=len(own)).astype(np.int64)
    ids, at = np.unique(np.concatenate((own[q], rep[i])), return_inverse=True)
    top = forest(len(ids), at[: len(q)], at[len(q) :])
    edge = np.flatnonzero(top != np.arange(len(ids)))
    some = np.flatnonzero(n)
    size = len(some) + len(edge)
    b = pa.array(np.concatenate((np.zeros(len(some), np.int64), ids[top[edge]])), mask=np.arange(size) < len(some))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((own[some], ids[edge]))), b, pa.array(np.concatenate((n[some], np.zeros(len(edge), np.int64))))], ["a", "b", "n"]
    )


def _ask(least: float):
    """Rows in order of (dim, shard, block): the pieces of the shard's graph first, then the block's queries, which pass through
    ``BLOCK`` at a time. A task holds one graph and so many queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, graph, held = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield _answers(*graph, pa.Table.from_batches(held), least)
                held.clear()

        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("dim", "shard", "block", "asks")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if key != (now := tuple(marks[:3, start])):
                    yield from flush()
                    key, pieces, graph = now, [], None
                if not marks[3, start]:
                    pieces += b.column("data").slice(start, stop - start).to_pylist()
                    continue
                if graph is None and not pieces:  # no vector of this length is in the shard
                    continue
                if graph is None:
                    vectors, links, level, rep, mult = pickle.loads(b"".join(pieces))
                    pieces, index, net = [], _matrix(vectors), Hnsw.__new__(Hnsw)
                    net.x, net.links, net.level = index.astype(np.float32), links, level
                    graph = net, index, rep, mult
                while start < stop:
                    room = min(stop - start, BLOCK - sum(x.num_rows for x in held))
                    held.append(b.select(["rep", "embedding"]).slice(start, room))
                    start += room
                    if sum(x.num_rows for x in held) == BLOCK:
                        yield from flush()
        yield from flush()

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, ...).

    n_links: other vectors with a cosine of at least ``least`` in double precision; component_id: the
    smallest vec_id reachable by links, itself included; kept: whether that is the row's own.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never link. Repeated rows (same id and vector) are one vector and
    answer alike; rows with a null vec_id link with nothing (component_id and kept null). An empty
    table gives no rows; further columns are ignored.

    Equal vectors are one class, which is indexed once and counts as often as it has ids. The classes
    are dealt into shards by hash; each class is asked of every shard's graph. A shard's graph goes to as many tasks as share its
    queries: ``BLOCKS``, or as many as there are shards, so that graphs are copied no more often than queries.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = rows.where("ok").select("vec_id", "embedding").distinct()
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("h", F.xxhash64("embedding")))
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()
    s = max(shards, -(-8 * size // shard_bytes))
    placed = classes.select(F.size("embedding").alias("dim"), "embedding", "rep", "mult", "h")
    index = cut(
        placed.withColumn("shard", F.pmod("h", F.lit(s)).cast("int"))
        .groupBy("dim", "shard")
        .applyInArrow(_build, "dim int, shard int, piece int, data binary")
    )
    blocks = min(-(-n // BLOCK), max(s, BLOCKS)) or 1
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = lambda c: F.lit(None).cast(placed.schema[c].dataType).alias(c)
    queries = placed.select(
        "dim", each(s).alias("shard"), F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("asks"),
        F.lit(0).alias("piece"), F.lit(None).cast("binary").alias("data"), "rep", "embedding",
    )
    graphs = index.select("dim", "shard", each(blocks).alias("block"), F.lit(0).alias("asks"), "piece", "data", none("rep"), none("embedding"))
    task = ["dim", "shard", "block"]
    dealt = graphs.unionByName(queries).repartition(s * blocks, *task).sortWithinPartitions(*task, "asks", "piece", "rep")
    found = cut(dealt.mapInArrow(_ask(least), "a long, b long, n long"))
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    answer = (
        classes.select("h", F.col("embedding").alias("e"), "rep", "mult")
        .join(linked, "rep", "left")
        .join(joined, "rep", "left")
        .select("h", "e", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    key = F.when(F.col("ok"), F.xxhash64("embedding"))
    out = rows.withColumn("k", key).join(answer, (F.col("k") == F.col("h")) & (F.col("embedding") == F.col("e")), "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("vec_id")).alias("kept"))


def dedup(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """The rows of ``vectors`` that stay: one of each component, and all that link with nothing. Of several rows of one vec_id that
    of the smallest hash of all its columns stays; rows with a null vec_id all stay."""

    def kept(d: DataFrame) -> DataFrame:
        keep = near_duplicates(d, least).where("kept").select(F.col("vec_id").alias("_ql_id")).distinct()
        row = F.struct(*d.columns)
        own = d.join(keep, d["vec_id"].cast("long") == F.col("_ql_id"), "left_semi")
        one = own.groupBy("vec_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_ql_row")).select("_ql_row.*")
        return one.unionByName(d.where("vec_id is null"))

    return aside(vectors, kept)

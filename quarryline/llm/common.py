"""What several operators share: tables in the shared folder, connected components, Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts.
WORD = r"[^\x20\x09-\x0D]+"

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session names none, a folder of the user's home in the
    default file system, the shared store of a cluster; one of our own where that is a single machine's."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    home = files.getHomeDirectory()
    # a local default file system is that of one machine, as in tests
    return "file:///tmp/checkpoints/quarryline" if home.toUri().getScheme() == "file" else f"{home}/.quarryline"


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here, and a lost
    executor costs only the tasks that it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ql-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ql_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    _delete(df.sparkSession, df._ql_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in list(_WRITTEN):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has gone; the cluster's own cleaner owns the folder
            return


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, since texts may be very long. Spark bounds the bytes of a batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``work``; those whose names begin with _ql_ have other names meanwhile, so that they don't
    meet columns that ``work`` adds."""
    other = [f"own{c}" if c.lower().startswith("_ql_") else c for c in docs.columns]
    return work(docs.toDF(*other)).select(*other).toDF(*docs.columns)


#: A sieve has so many bits: 8 MB whatever the table holds, in pieces of 32,768 bits.
SIEVE_BITS, PIECE_BITS = 26, 15


def _place(h: Column) -> tuple[Column, Column]:
    at = F.shiftrightunsigned(h, 64 - SIEVE_BITS)
    return F.shiftright(at, PIECE_BITS), at.bitwiseAND(F.lit((1 << PIECE_BITS) - 1))


def sieve(hashes: DataFrame, h: str) -> DataFrame:
    """(_piece, _bits) of a set of hashes."""
    piece, bit = _place(F.col(h))
    return hashes.select(piece.alias("_piece"), bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def passes(rows: DataFrame, h: Column, through: DataFrame) -> DataFrame:
    """``rows`` with _in: false only where the hash isn't in the set. The sieve is broadcast; what it lets through is joined exactly later."""
    piece, bit = _place(h)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))).cast("int") % 2 == 1
    joined = rows.withColumn("_p", piece).join(F.broadcast(through), F.col("_p") == F.col("_piece"), "left")
    return joined.withColumn("_in", F.coalesce(inside, F.lit(False))).drop("_p", "_piece", "_bits")


#: Rows up to which a side of a join may be broadcast, as the planner likes. It goes by the bytes of files, which are compressed.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of up to ``rows`` rows as a side of a join, which is not broadcast beyond BROADCAST_ROWS."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


#: Edges that one task may hold to find components: 32 MB, and some 250 MB while it runs. Larger graphs go by rounds.
ONE_TASK_LINKS = 2_000_000


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n vertices by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # pointer jumping
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    return label


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of all edges (u, v) at once."""
    edges = pa.Table.from_batches(batches, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ids, at = np.unique(np.concatenate([c.to_numpy() for c in edges.columns]), return_inverse=True)
    top = ids[forest(len(ids), at[: len(edges)], at[len(edges) :])]
    yield from slices(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(top)], ["id", "component"])]), 1 << 16)


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, component), component the smallest
    id reachable. Vertices without an edge to another are absent.

    Up to ``one_task`` different edges one task finds them, which spares the driver the jobs, plans and broadcasts of the rounds.
    Beyond, alternates the large-star and small-star steps until the edges stay the same; each round is
    joins and minima by key, so a hub costs a partial aggregate and a join that can be split.
    Null ends and loops are ignored; no edges give no rows. The driver holds no table of more than BROADCAST_ROWS rows.
    """

    def star(e: DataFrame, rows: int) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(bounded(least, rows), "u")

    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if one_task and (n := e.count()) <= one_task:
        return bounded(e.coalesce(1).mapInArrow(_reached, "id long, component long"), 2 * n)
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        s = star(large, 2 * now[0])
        small = s.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(s.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, cut(small)
        drop(before)
    tops = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return bounded(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops), 2 * now[0])

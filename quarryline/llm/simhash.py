"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ONE_TASK_LINKS, aside, bounded, components, cut, forest, passes, sieve, slices

BITS = 64
BLOCKS = 7
#: Rows of a block's group that one tile holds of each side.
TILE = 512


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text (bytes of UTF-8); 0 where there is no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, size)
    h, digest = [], xxhash.xxh64_intdigest
    for a, b in zip(starts[: size - w + 1].tolist(), ends[w - 1 :].tolist(), strict=True):
        h.append(digest(joined[a:b], seed))
    total = np.zeros(BITS, np.int64)
    all_h = np.array(h, np.uint64)
    for i in range(0, len(h), 1 << 15):  # bounded memory for very long texts
        part = all_h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(total * 2 > len(h))
    return int(sum(1 << int(i) for i in ones))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int, blocks: int = BLOCKS) -> list[int]:
    """Masks of all choices of ``blocks - distance`` of the blocks: two fingerprints that differ in at
    most ``distance`` bits touch at most so many blocks and agree on all bits of some mask."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(x) for x in combinations(block, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def close_pairs(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within runs of equal keys whose fingerprints are close; a spanning set of them in
    long runs, so that a dense group gives a number of pairs in proportion to its size."""
    n = len(key)
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    start, stop = np.concatenate(([0], cuts)), np.concatenate((cuts, [n]))
    length = stop - start
    left, right = [], []
    short = np.repeat(length <= 8, length)
    end = np.repeat(stop, length)
    for off in range(1, int(length[length <= 8].max(initial=1))):
        i = np.flatnonzero(short[: n - off] & (np.arange(n - off) + off < end[: n - off]))
        ok = np.bitwise_count(fp[i] ^ fp[i + off]) <= distance
        left.append(i[ok])
        right.append(i[ok] + off)
    for s, e in zip(start[length > 8], stop[length > 8], strict=True):
        x = fp[s:e]
        label = np.arange(e - s)
        for r in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(x[r : r + 256, None] ^ x[None, :]) <= distance)
            label = forest(len(x), np.concatenate((np.arange(len(x)), i + r)), np.concatenate((label, j)))
        i = np.flatnonzero(label != np.arange(len(x)))
        left.append(i + s)
        right.append(label[i] + s)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def link(reps: DataFrame, distance: int = 4, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect exactly the groups of ``reps`` (fp, rep) with close fingerprints.

    Each fingerprint is keyed by every mask; keys with one fingerprint are left out by a count.
    A key with more than ``tile`` fingerprints is dealt into tiles by a hash of the fingerprint, each
    pair of parts a task's group of its own: nothing is dropped, and no task holds more than two parts.

    The counts are joined by sorting: the planner takes the keyed rows for no more than the file of ``reps``,
    not for a row of each mask, and would send them all to the driver for a broadcast.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(distance, blocks)])
    keyed = reps.select("fp", "rep", F.posexplode(masks).alias("m", "mask")).select(
        F.xxhash64("m", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "fp", "rep"
    )
    several = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    dealt = (
        keyed.join(several.hint("merge"), "k")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "fp", "rep")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            i, j = close_pairs(cols[0], cols[1].view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(cols[2][i]), pa.array(cols[2][j])], ["a", "b"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            at = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last run may go on
            held = [c[at:].copy() for c in cols]
            if at:
                yield found([c[:at] for c in cols])
        if held is not None and len(held[0]):
            yield found(held)

    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable by links of
    at most ``distance`` differing bits. Texts without words have fingerprint 0 and link like any
    other. Repeated rows give repeated rows; a null doc_id gets a fingerprint but stands outside
    every group (component_id null); an empty table gives no rows; further columns are ignored.
    """
    prints = cut(fingerprints(docs, width, seed))
    reps = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(link(reps, distance), ONE_TASK_LINKS)
    named = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("c"))
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
    )


def dedup(docs: DataFrame, distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the row of the smallest doc_id, once.

    Of several rows of one doc_id that of the smallest hash of all its columns stays, and one of those that are the same in
    all. Rows with a null doc_id belong to no group and all stay. Null and empty texts are a group. An empty table gives no rows.

    Ids are decided on, not rows: a broadcast sieve of 8 MB parts the rows whose ids neither go nor come again, which stay where
    they are, from the others, which are joined with the decisions.
    """
    ids = near_duplicates(docs, distance, width, seed).where("doc_id is not null").groupBy("doc_id")
    decided = ids.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("_ql_stays"), F.count("*").alias("_ql_n"))
    odd = cut(decided.where("not _ql_stays or _ql_n > 1").select(F.col("doc_id").alias("_ql_id"), "_ql_stays").withColumn("_ql_h", F.xxhash64("_ql_id")))
    decisions = bounded(odd, odd.count())

    def kept(d: DataFrame) -> DataFrame:
        sieved = passes(d, F.coalesce(F.xxhash64(F.col("doc_id").cast("long")), F.lit(0)), sieve(odd, "_ql_h"))
        plain = F.col("doc_id").isNull() | ~F.col("_in")
        rest = sieved.where(~plain).drop("_in")
        rest = rest.join(decisions, rest["doc_id"].cast("long") == F.col("_ql_id"), "left").where(F.coalesce("_ql_stays", F.lit(True)))
        row = F.struct(*d.columns)
        again = rest.where("_ql_id is not null").groupBy("_ql_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_ql_row")).select("_ql_row.*")
        return sieved.where(plain).select(*d.columns).unionByName(rest.where("_ql_id is null").select(*d.columns)).unionByName(again)

    return aside(docs, kept)

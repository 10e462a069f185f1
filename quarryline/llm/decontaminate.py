"""Benchmark decontamination with a broadcast set of word windows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quarryline.llm.common import aside, cut, slices
from quarryline.llm.wordhash import Words

#: Bytes of benchmark text up to which its windows are sent to the executors; bits of the set that is sent beyond.
SLICE_BYTES, SIEVE_BITS = 16 << 20, 29
#: A-Z lower-cased; bytes that are neither ASCII letters or digits nor of other characters part words.
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


_GAPS = np.zeros(256, bool)
_GAPS[[10, 32]] = True


def _joined(texts: list[bytes | None]) -> tuple[Words, np.ndarray]:
    """The words of several texts, and how many words stand before each of them (one more number than texts)."""
    normal = [b" ".join(words(t)) for t in texts]
    w = Words(b"\n".join(normal), _GAPS)
    begin = np.cumsum([0, *(len(t) + 1 for t in normal)])
    return w, np.searchsorted(w.starts, begin)


def _windows(first: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows of a size that lie within one text."""
    return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b - size + 1) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b - a >= size)])


class WindowSet:
    """Windows of benchmark items as flat arrays: sorted hashes, where the window stands in the items' text, and its items.

    Of 16 MB of items they take less than 100 MB. A set of bits by hash stands before the search.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], width: int = 10):
        self.names = sorted({i for i, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        w, first = _joined([t for _, t in items])
        n = np.minimum(np.diff(first), width)
        starts = [np.arange(a, b - k + 1) for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), n.tolist(), strict=True) if k]
        at = np.concatenate([np.zeros(0, np.int64), *starts])
        item = np.repeat(np.array([number[i] for (i, _), k in zip(items, n.tolist(), strict=True) if k], np.int32), [len(x) for x in starts])
        size = np.repeat(n[n > 0], [len(x) for x in starts])
        self.sizes = sorted(set(n[n > 0].tolist()))
        h = w.hash(at, at + size - 1)
        order = np.lexsort((item, h))
        h, at, size, item = h[order], at[order], size[order], item[order]
        self.text = w.raw.tobytes()
        start, length = w.starts[at], w.ends[at + size - 1] - w.starts[at]
        new = np.ones(len(h), bool)
        for i in np.flatnonzero(h[1:] == h[:-1]) + 1:  # the same words, but for a chance of 2 ** -64 a pair
            a, b = start[i - 1], start[i]
            new[i] = self.text[a : a + length[i - 1]] != self.text[b : b + length[i]]
        keep = np.flatnonzero(new)
        self.keys, self.start, self.length = h[keep], start[keep].astype(np.int32), length[keep].astype(np.int32)
        self.of, self.item = np.append(keep, len(h)).astype(np.int32), item
        self.shift = np.uint64(64 - max(10, int(16 * len(h)).bit_length()))
        self.bits = np.zeros(1 << (61 - int(self.shift)), np.uint8)
        place = self.keys >> self.shift
        np.bitwise_or.at(self.bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes that may be in the set: all that are, and few others."""
        place = h >> self.shift
        return np.flatnonzero((self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[int], list[str]]]:
        """Of each text the number of words, the borders of its hit stretches, as [start, stop, start, stop ...], and the items found."""
        w, first = _joined(texts)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for n in self.sizes:
            at = _windows(first, n)
            h = w.hash(at, at + n - 1)
            some = self.maybe(h)
            at, h = at[some], h[some]
            low, high = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
            some = np.flatnonzero(high > low)
            text_of = np.searchsorted(first, at[some], side="right") - 1
            for i, a, k, lo, hi in zip(at[some].tolist(), w.starts[at[some]].tolist(), text_of.tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                window = w.raw[a : w.ends[i + n - 1]].tobytes()
                for e in range(lo, hi):
                    s = self.start[e]
                    if self.text[s : s + self.length[e]] == window:
                        spans[k].append((i - int(first[k]), i - int(first[k]) + n))
                        items[k].update(self.item[self.of[e] : self.of[e + 1]].tolist())
        return [(int(first[k + 1] - first[k]), merged(spans[k]), sorted(self.names[i] for i in items[k])) for k in range(len(texts))]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` with _ql_n_words int, _ql_spans array<int> (hit stretches of word numbers as borders) and
    _ql_items array<string>. Every text is scanned once, whole, however long. Columns of ``docs`` of these names are replaced.

    The windows of the benchmark, as hashes with the items' text to verify them, are sent to the executors while the
    texts have at most ``slice_bytes`` bytes. Beyond that a set of bits of at most SIEVE_BITS bits is sent, and the windows
    that it lets through are joined with those of the benchmark, word for word.
    """
    spark = docs.sparkSession
    docs = docs.drop("_ql_n_words", "_ql_spans", "_ql_items")
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > slice_bytes:
        return _joined_hits(docs, bench, width)
    rows = bench.collect()
    shared = spark.sparkContext.broadcast(WindowSet([(r["item_id"], (r["text"] or "").encode("utf-8", "surrogatepass")) for r in rows], width))
    kept = docs.columns
    at = kept.index("text")
    more = [StructField("_ql_n_words", IntegerType()), StructField("_ql_spans", ArrayType(IntegerType())), StructField("_ql_items", ArrayType(StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            n, spans, items = zip(*shared.value.scan(b.column(at).cast(pa.binary()).to_pylist()), strict=True)
            found = [pa.array(n, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*kept, "_ql_n_words", "_ql_spans", "_ql_items"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def _joined_hits(docs: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """hits() for a benchmark of any size: windows that pass a set of bits are joined with the benchmark's."""
    spark = docs.sparkSession

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w, first = _joined(b.column(1).cast(pa.binary()).to_pylist())
            for k, name in enumerate(b.column(0).to_pylist()):
                n = min(width, int(first[k + 1] - first[k]))
                at = np.arange(first[k], first[k + 1] - n + 1) if n else np.zeros(0, np.int64)
                h = w.hash(at, at + n - 1).view(np.int64)
                text = [w.raw[w.starts[i] : w.ends[i + n - 1]].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([n] * len(at), pa.int32()), pa.array(h), pa.array(text, pa.binary())], ["item_id", "n", "h", "w"])

    wins = cut(bench.mapInArrow(spread, "item_id string, n int, h long, w binary").distinct())
    sizes = sorted(r[0] for r in wins.select("n").distinct().collect())  # at most ``width``
    bits = spark.sparkContext.broadcast(_bits(wins))
    a, b = F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            w, first = _joined(batch.column(2).cast(pa.binary()).to_pylist())
            for n in sizes:
                at = _windows(first, n)
                place = w.hash(at, at + n - 1) >> np.uint64(64 - SIEVE_BITS)
                at = at[((bits.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1) > 0]
                k = np.searchsorted(first, at, side="right") - 1
                text = [w.raw[w.starts[i] : w.ends[i + n - 1]].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(k)), batch.column(1).take(pa.array(k)), pa.array((at - first[k]).astype(np.int32)), pa.array([n] * len(at), pa.int32()), pa.array(text, pa.binary())],
                    ["_a", "_b", "i", "n", "w"],
                )

    seen = docs.select(a.alias("_a"), b.alias("_b"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(candidates, "_a long, _b long, i int, n int, w binary")
    found = seen.join(wins, ["n", "w"]).groupBy("_a", "_b").agg(F.sort_array(F.collect_set(F.struct("i", (F.col("i") + F.col("n")).alias("j")))).alias("s"), F.sort_array(F.collect_set("item_id")).alias("_ql_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches):
            spans = [merged([(v["i"], v["j"]) for v in s]) for s in x.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(spans, pa.list_(pa.int32())), x.column(3)], ["_ql_a", "_ql_b", "_ql_spans", "_ql_items"])

    spans = cut(found.mapInArrow(merge, "_ql_a long, _ql_b long, _ql_spans array<int>, _ql_items array<string>"))
    whole = docs.withColumns({"_ql_x": a, "_ql_y": b}).join(spans, (F.col("_ql_x") == F.col("_ql_a")) & (F.col("_ql_y") == F.col("_ql_b")), "left")
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0))
    return whole.select(
        *docs.columns,
        count.cast("int").alias("_ql_n_words"),
        F.coalesce("_ql_spans", F.array().cast("array<int>")).alias("_ql_spans"),
        F.coalesce("_ql_items", F.array().cast("array<string>")).alias("_ql_items"),
    )


def _bits(wins: DataFrame) -> np.ndarray:
    """A bit for each of 2 ** SIEVE_BITS ranges of the windows' hashes: 64 MB, whatever the benchmark's size."""
    place = F.shiftrightunsigned("h", 64 - SIEVE_BITS)
    pieces = wins.select(F.shiftright(place, 15).alias("p"), place.bitwiseAND(F.lit(32767)).alias("b")).groupBy("p").agg(F.bitmap_construct_agg("b").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
    for r in pieces.toLocalIterator():
        out[r["p"] * 4096 : (r["p"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    Words: maximal runs of ASCII letters and digits and of all non-ASCII characters, A-Z
    lower-cased. A window is ``width`` consecutive words of an item; an item of fewer words, but not
    none, is one window. A document word inside any occurrence of a window is hit. Null and empty
    texts have no words; null item_ids are ignored; repeated rows give repeated rows; an empty
    benchmark hits nothing; texts are scanned whole, however long; further columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1).cast(pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array([n > 0 for n in n_hit]),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = hits(docs.select("doc_id", "text"), benchmark, width, slice_bytes).select("doc_id", "_ql_n_words", "_ql_spans", "_ql_items")
    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text no window of the benchmark occurs in; all columns stay."""
    return aside(docs, lambda d: hits(d, benchmark, width, slice_bytes).where(F.size("_ql_spans") == 0))


def redact(docs: DataFrame, benchmark: DataFrame, width: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with the hit stretches cut out of the texts; what stands between words goes with them. Null texts stay null."""

    def cut_out(d: DataFrame) -> DataFrame:
        at, cols, schema = d.columns.index("text"), d.columns, d.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                texts = b.column(at).cast(pa.binary()).to_pylist()
                for i, spans in enumerate(b.column(len(cols) + 1).to_pylist()):
                    if spans:
                        texts[i] = without(texts[i], spans)
                arrays = [*b.columns[: len(cols)]]
                arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, cols)

        return hits(d, benchmark, width, slice_bytes).mapInArrow(run, schema)

    return aside(docs, cut_out)


def without(text: bytes, spans: list[int]) -> bytes:
    """A text (UTF-8) without the words of the given stretches and the parts between these words."""
    mapped = text.translate(_TO_WORDS)
    borders = [m.span() for m in re.finditer(rb"[^ ]+", mapped)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : borders[a][0]])
        at = borders[b - 1][1]
    return b"".join([*out, text[at:]])

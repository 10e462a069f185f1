"""Toxicity scores from class-conditional Kneser-Ney models of the spelling of words."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from quarryline.llm.common import aside, cut, slices

#: Characters of context at each level of the models.
CONTEXTS = (0, 1, 2, 4, 7)
#: Of a class's own counts of one, two, and more so much is discounted at least, whatever the estimate: a word that one document of a class has says
#: nothing about the class yet.
CLASS_DISCOUNTS = np.ones(3)
#: Labelled documents of each class that the models are fitted on at most, and bytes of their texts together.
SAMPLE, SAMPLE_BYTES = 2500, 6 << 20
#: Parts of the sample, each scored by models of the others.
FOLDS = 4
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All characters (bytes) of the words, each word between a start and an end mark; word numbers.

    The marks are the bytes 1 and 2. A control character of the same value in a word changes only how
    that word is spelt to the models, the same way in training and scoring.
    """
    joined = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8)
    number = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    return joined, number


def _grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of CONTEXTS: hashes of context and of context with character, at every character but the
    start marks, and the word numbers. A context reaches back to the start mark at most."""
    chars, number = _spelling(words)
    n = len(chars)
    start = np.ones(n, bool)
    start[1:] = number[1:] != number[:-1]
    place = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0))  # 0 at the start mark
    at = np.flatnonzero(~start)
    place, number = place[at], number[at]
    context = np.full(len(at), _P)  # never 0, which marks a free place in a table
    wide = chars.astype(np.uint64) + np.uint64(1)
    last = wide[at] * np.uint64(0xD6E8FEB86659FD93)
    for k in range(CONTEXTS[-1] + 1):
        if k:
            back = wide[np.maximum(at - k, 0)]
            context = np.where(place >= k, (context + back) * _P ^ (context >> np.uint64(29)), context)
        if k in CONTEXTS:
            g = (context ^ last) * _P
            yield context, g ^ (g >> np.uint64(31)), number


class _Table:
    """Columns of sums by hash in an open-addressed table, half empty; zeros where a hash is absent."""

    def __init__(self, keys: np.ndarray, columns: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(keys) * 2).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros((len(self.keys), columns.shape[1]), np.float32)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            mine, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[mine], self.values[mine] = keys[put], columns[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        full = self.keys != 0
        return self.keys[full], self.values[full]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), self.values.shape[1]), np.float32)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
        return out


def discounts(count: np.ndarray) -> np.ndarray:
    """What is taken from counts of one, two, and three or more: estimated from how many grams have counts of one to
    four, each at most the count itself and at least 0.1, since something must go to what is unseen. Where one of these is missing, all of a count of one goes, and as much of the others."""
    n = np.bincount(np.minimum(count[count > 0], 5).astype(np.int64), minlength=6)[1:5].astype(np.float64)
    if not n.all():
        return np.ones(3)
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 0.1, (1, 2, 3))


def _discount(count: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What is taken from a count and given to the distribution below."""
    return np.where(count > 2, off[2], np.where(count > 1, off[1], np.minimum(count, off[0])))


def _tables(gram: np.ndarray, context: np.ndarray, number: np.ndarray, weights: list[np.ndarray]) -> tuple[_Table, _Table]:
    """For each of the weights (by number): by gram its count less the discount, and by context the count and what
    is discounted after it. The discounts are those of the first of the weights, but all of a class's own count of one goes: it
    says nothing about a class yet."""
    g, first, where = np.unique(gram, return_index=True, return_inverse=True)
    context = context[first]
    count = np.stack([np.bincount(where, weights=w[number], minlength=len(g)) for w in weights], axis=1)
    del where
    of = discounts(count[:, 0])
    off = _discount(count, of)
    if len(weights) > 1:
        off[:, 1:] = _discount(count[:, 1:], np.maximum(of, CLASS_DISCOUNTS))
    c, where = np.unique(context, return_inverse=True)
    total, given = (np.stack([np.bincount(where, weights=w, minlength=len(c)) for w in x.T], axis=1) for x in (count, off))
    # a gram of which nothing is left, and a context after which all is discounted, say what an absent one says
    some, rest = (count > off).any(axis=1), (total > given).any(axis=1)
    return _Table(g[some], (count - off)[some]), _Table(c[rest], np.concatenate((total, given), axis=1)[rest])


def _mixed(above: np.ndarray, total: np.ndarray, off: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.where(total > 0, (above + off * below) / np.maximum(total, 1), below)


class ClassModels:
    """Toxic and ordinary models of how words are spelt.

    Each class has counts of the longest order of its own; what is discounted from them goes to one
    distribution that both share: the pooled counts of that order, and below it Kneser-Ney continuation counts.
    So where a class hasn't seen a rare spelling, both models say the same.
    """

    def __init__(self, counts: dict[bytes, tuple[int, int]]):
        words = list(counts)
        n = np.array([counts[w] for w in words], np.float64).reshape(-1, 2)
        self.lower = []
        before = None
        for context, gram, number in _grams(words):
            if before is not None:
                # a gram counts once for each different context of the next level that it follows
                first = np.unique(gram, return_index=True)[1]
                self.lower.append(_tables(before[1][first], before[0][first], np.zeros(len(first), np.int32), [np.ones(1)]))
            before = context, gram
        self.top = _tables(*before[::-1], number, [n.sum(axis=1), n[:, 0], n[:, 1]])

    def dump(self) -> bytes:
        return pickle.dumps([[t.items() for t in pair] for pair in (*self.lower, self.top)])

    @classmethod
    def load(cls, blob: bytes) -> ClassModels:
        self = cls.__new__(cls)
        *self.lower, self.top = [tuple(_Table(*t) for t in pair) for pair in pickle.loads(blob)]
        return self

    def ratio(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words:
            return np.zeros(0)
        p = None
        for k, (context, gram, number) in enumerate(_grams(words)):
            g, c = (*self.lower, self.top)[k]
            above, total = g(gram), c(context)
            p = np.full(len(number), 1 / 256, np.float32) if p is None else p
            p = _mixed(above[:, 0], total[:, 0], total[:, total.shape[1] // 2], p)
        ordinary, toxic = (_mixed(above[:, y], total[:, y], total[:, 3 + y], p) for y in (1, 2))
        return np.bincount(number, weights=np.log(toxic) - np.log(ordinary), minlength=len(words))


class Scorer:
    """Statistics and scores of documents, remembering the words seen last."""

    def __init__(self, models: ClassModels, line: tuple[float, float] | None = None):
        self.models, self.line = models, line
        self.known: dict[bytes, float] = {}

    def differences(self, texts: list[bytes | None]) -> np.ndarray:
        """Of each text the length-normalised difference of its log-likelihoods: log of the mean over its different words of
        P(word | toxic) / P(word | ordinary). That is the likelihood of a text with one toxic word, whichever it is,
        against that of an ordinary one; a text without words is as likely either way (0)."""
        docs = [set(tokens(t)) for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        fresh = list(set().union(*docs) - self.known.keys())
        self.known.update(zip(fresh, np.exp(self.models.ratio(fresh)).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([math.log(math.fsum(map(get, d)) / len(d)) if d else 0.0 for d in docs])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return logistic(self.differences(texts), self.line)


def logistic(x: np.ndarray, line: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(line[0] + line[1] * x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton's method; the slope is ``least`` at least, so that the score rises with the difference."""
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-9, 1e-4 * weight.sum()])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + ridge, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), max(least, float(w[1]))


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of the five-word shingles of each text, to leave copies out of a sample."""
    for b in slices(batches):
        least = []
        for t in b.column(0).cast(pa.binary()).to_pylist():
            w = tokens(t)
            h = np.array([xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], np.uint64)
            least.append((h.min(), (h * _P).min()))
        both = np.array(least, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], ["text", "toxic", "h", "doc_id", "s0", "s1"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of a document are kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled models of a sample (h, doc_id, t, toxic, text), and the label and difference of each of its documents."""
    rows = pa.Table.from_batches(batches, schema=_SAMPLE).sort_by([("h", "ascending"), ("doc_id", "ascending"), ("t", "ascending")])
    y, fold = rows.column(3).to_numpy(), rows.column(0).to_numpy() % FOLDS
    texts = rows.column(4).cast(pa.binary()).to_pylist()
    counts: dict[bytes, np.ndarray] = {}  # documents that have a word, by fold and class
    for t, f, c in zip(texts, fold.tolist(), y.tolist(), strict=True):
        for w in set(tokens(t)):
            if w not in counts:
                counts[w] = np.zeros((FOLDS, 2), np.int16)
            counts[w][f, c] += 1
    words = sorted(counts)
    n = np.array([counts[w] for w in words], np.int64).reshape(-1, FOLDS, 2)
    del counts
    models = lambda k: ClassModels({w: c for w, c in zip(words, k.tolist(), strict=True) if c[0] or c[1]})
    x = np.zeros(len(texts))
    for f in range(FOLDS):
        at = np.flatnonzero(fold == f)
        if len(at):
            x[at] = Scorer(models(n.sum(axis=1) - n[:, f])).differences([texts[i] for i in at])
    yield pa.RecordBatch.from_arrays([pa.array([models(n.sum(axis=1)).dump()], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.float64())], ["m", "y", "x"])
    yield pa.RecordBatch.from_arrays([pa.array([None] * len(y), pa.binary()), pa.array(y, pa.int32()), pa.array(x)], ["m", "y", "x"])


_SAMPLE = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("toxic", pa.int32()), ("text", pa.string())])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[bytes, tuple[float, float]] | None:
    """Fit on labelled documents that are not held out: the pickled models, and bias and slope of the score; None where a class
    has no document. Of each class these are the documents of the smallest hashes of doc_id, at most ``sample``, as long
    as their texts together have at most ``sample_bytes`` bytes; all words of each of them count. A document with several labels is
    toxic if one says so; null ids and labels are ignored; of texts that share a min-hash the smallest id stays.

    The models are made by one task, which holds no more than the sample. Models of the other folds score each document for bias
    and slope, so that these come from documents that a model has not seen; the final models hold all folds. All
    choices go by total orders and sums are of whole numbers, so the same rows give the same fit, however they are dealt.
    """
    marked = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    total = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if not (total.get(0) and total.get(1)):
        return None
    of = lambda rows, y: rows.where(F.col("toxic") == y).orderBy("h", "doc_id", "t").limit(sample)
    first = marked.withColumn("t", F.lit(0))
    picked = of(first, 0).unionByName(of(first, 1)).select(F.col("doc_id").alias("i"), "toxic", "h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("i")).select("text", "toxic", "h", "doc_id")  # 2 * sample ids
    place = F.struct("h", "doc_id", F.xxhash64("text").alias("t"))
    rows = found.where(F.octet_length("text") <= sample_bytes).mapInArrow(sketch, "text string, toxic int, h long, doc_id long, s0 long, s1 long").withColumn("at", place)
    for s in ("s0", "s1"):
        rows = rows.groupBy(s, "toxic").agg(F.min_by(F.struct("text", "at", "s1"), "at").alias("x")).select("toxic", "x.*")
    rows = cut(rows.select("text", "toxic", "at.*"))
    upto = F.sum(F.octet_length("text")).over(W.partitionBy("toxic").orderBy("h", "doc_id", "t").rowsBetween(W.unboundedPreceding, 0))
    chosen = of(rows, 0).unionByName(of(rows, 1)).withColumn("_upto", upto).where(F.col("_upto") <= sample_bytes)
    fitted = chosen.select("h", "doc_id", "t", "toxic", "text").coalesce(1).mapInArrow(_fit, "m binary, y int, x double").toArrow()
    blobs = fitted.column(0).drop_null().to_pylist()
    if len(blobs) != 1:
        raise RuntimeError(f"{len(blobs)} models have arrived")
    seen = fitted.filter(pc.is_valid(fitted.column(1))).select(["y", "x"])  # 2 * sample rows at most
    y, x = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    share = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    return blobs[0], fit_logistic(x, y, share * len(y) / share.sum())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs``, and _ql_score double and _ql_toxic boolean (score >= threshold).

    The score rises with the length-normalised difference alone, see Scorer.differences. The whole text is scored, however
    long, batch by batch. Null and empty texts have no words: their difference is 0. Where the
    labels lack a class, every score is 0. Repeated rows score alike; an empty table gives no rows. Columns of ``docs`` named
    _ql_score or _ql_toxic are replaced.
    """
    docs = docs.drop("_ql_score", "_ql_toxic")
    fitted = train(docs, labels, sample)
    if fitted is None:
        return docs.withColumns({"_ql_score": F.lit(0.0), "_ql_toxic": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    at, cols = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in slices(batches, 64):
            own = own or Scorer(ClassModels.load(shared.value[0]), shared.value[1])
            s = own.scores(b.column(at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(s >= threshold)], [*cols, "_ql_score", "_ql_toxic"])

    schema = StructType([*docs.schema.fields, StructField("_ql_score", DoubleType()), StructField("_ql_toxic", BooleanType())])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``. A null doc_id is not held out."""
    found = score(docs.select("doc_id", "text"), labels, threshold, sample)
    return found.select("doc_id", held_out().alias("held_out"), F.col("_ql_score").alias("score"), F.col("_ql_toxic").cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were; rows and texts of any kind as in score()."""
    return aside(docs, lambda d: score(d, labels, threshold, sample).where(~F.col("_ql_toxic")))

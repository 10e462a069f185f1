"""Masked pseudo-likelihood scores of every word from a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quarryline.llm.common import cut, slices
from quarryline.llm.wordhash import Table, Words

#: Words that are classes of their own, and classes of the other words, by their last two bytes.
SINGLE, ENDINGS = 23, 24
#: Classes: the border of a text, single words, endings.
CLASSES = 1 + SINGLE + ENDINGS
#: Groups of classes, and words on each side that are seen: the nearest by its class, the others by the group that most are of.
GROUPS, REACH = 4, 4
CONTEXTS = CLASSES * CLASSES * GROUPS
#: Words whose counts every task holds, the most frequent ones; the counts of the others are joined.
KNOWN = 1 << 20
#: Counts that the border of known words is found among one by one; above, in steps of a 64th of a doubling.
COUNTS = 4096
#: Bits of the set of words beyond KNOWN that occur more than once: 8 MB.
SIEVE_BITS = 26
#: Width of the embeddings, of a group's, and of the hidden layer; rounds over all contexts, and parts of a round.
WIDTH, GROUP_WIDTH, HIDDEN, ROUNDS, PARTS = 16, 4, 48, 100, 4
#: Words that a task counts before it passes the counts on.
HELD = 1 << 20
#: Log-probabilities are summed over tasks as whole numbers of this fraction, so that their order doesn't matter.
_UNIT = 2.0**-32
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: list[bytes | None]) -> tuple[Words, np.ndarray]:
    """The words of texts, A-Z lower-cased, parted by ASCII white space; how many stand before each text (one more number than texts)."""
    low = [(t or b"").lower() for t in texts]
    w = Words(b"\n".join(low), _GAPS)
    return w, np.searchsorted(w.starts, np.cumsum([0, *(len(t) + 1 for t in low)]))


def endings(w: Words) -> np.ndarray:
    """Of each word the class of its last two bytes (one, where it has no more)."""
    last, before = w.raw[w.ends - 1].astype(np.int64), np.where(w.ends - w.starts > 1, w.raw[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
    return (1 + SINGLE + (last * 256 + before) * 40503 % 65521 % ENDINGS).astype(np.int16)


class Vocabulary:
    """Classes of words, and log-probabilities of words within their classes, by counts over the whole corpus."""

    def __init__(self, h: np.ndarray, cls: np.ndarray, n: np.ndarray, mass: np.ndarray, rest: np.ndarray | None = None):
        """h, cls, n: hashes, classes by ending, and counts of the known words. mass: the count of all words of the corpus, by
        class by ending. rest: bits of the words that aren't known and occur more than once."""
        order = np.lexsort((h, -n))
        cls, mass = cls.astype(np.int16).copy(), mass.astype(np.float64).copy()
        for i, k in enumerate(order[:SINGLE]):
            mass[cls[k]] -= n[k]
            cls[k], mass[1 + i] = 1 + i, n[k]
        #: Of a word that occurs once.
        self.once = -np.log(np.maximum(mass, 1))
        self.table = Table(h, cls, (np.log(n) + self.once[cls]).astype(np.float64))
        self.rest = rest

    def lookup(self, h: np.ndarray, by_ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, log-probabilities within them, and where a word's count must be joined: log n is to be added there."""
        at = self.table.find(h)
        known = at >= 0
        cls = np.where(known, self.table.values[0][at], by_ending).astype(np.int64)
        own = np.where(known, self.table.values[1][at], self.once[cls])
        if self.rest is None:
            return cls, own, np.zeros(len(h), bool)
        place = h >> np.uint64(64 - SIEVE_BITS)
        return cls, own, ~known & ((self.rest[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0)


def neighbours(cls: np.ndarray, first: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Numbers of the contexts of words: (class to the left, class to the right, group that most of the other words within REACH
    are of). Beyond the ends of a text stand REACH borders, class 0, which are of no group; the first group where none leads."""
    n, texts = len(cls), len(first) - 1
    of = np.repeat(np.arange(texts), np.diff(first))
    at = np.arange(n) + REACH * (of + 1)
    wide = np.zeros(n + REACH * (texts + 1), np.int64)
    wide[at] = cls
    votes = np.zeros((GROUPS, n), np.int8)
    group = np.where(wide > 0, groups[wide], -1)
    for k in range(2, REACH + 1):
        for side in (group[at - k], group[at + k]):
            for g in range(GROUPS):
                votes[g] += side == g
    return (wide[at - 1] * CLASSES + wide[at + 1]) * GROUPS + votes.argmax(axis=0)


def grouped(pairs: np.ndarray) -> np.ndarray:
    """Groups of classes that stand beside each other, by the counts of neighbours: clusters of the leading eigenvectors."""
    near = pairs + pairs.T + 1e-3
    near[0] = near[:, 0] = 1e-3
    scale = 1 / np.sqrt(near.sum(axis=1))
    _, v = np.linalg.eigh(near * scale[:, None] * scale[None, :])
    x = v[:, -GROUPS:]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    weight = near.sum(axis=1)
    centres = [x[weight.argmax()]]
    while len(centres) < GROUPS:  # the class that is farthest from all centres, by its weight
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[(far * weight).argmax()])
    c = np.array(centres)
    for _ in range(50):
        of = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([np.average(x[of == g], axis=0, weights=weight[of == g]) if (of == g).any() else c[g] for g in range(GROUPS)])
    return of


class WindowNetwork:
    """P(class | context): embeddings of the words at both sides and of the group around, a hidden layer, softmax."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *s: r.standard_normal(s) / np.sqrt(s[0])
        self.p = {
            "l": draw(CLASSES, WIDTH), "r": draw(CLASSES, WIDTH), "g": draw(GROUPS, GROUP_WIDTH), "h": draw(2 * WIDTH + GROUP_WIDTH, HIDDEN), "hb": np.zeros(HIDDEN),
            "o": draw(HIDDEN, CLASSES), "ob": np.zeros(CLASSES),
        }

    def forward(self, context: np.ndarray):
        left, right, group = context // (CLASSES * GROUPS), context // GROUPS % CLASSES, context % GROUPS
        x = np.concatenate((self.p["l"][left], self.p["r"][right], self.p["g"][group]), axis=1)
        h = np.tanh(x @ self.p["h"] + self.p["hb"])
        z = h @ self.p["o"] + self.p["ob"]
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, counts: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02) -> list[float]:
        """Adam on the log-likelihood of all words of the corpus: counts (context, class) hold every word with its
        context. Each round takes all contexts in parts. Returns losses per word."""
        total = counts.sum(axis=1)
        used = np.flatnonzero(total)
        if not len(used):
            return []
        order = np.random.default_rng(5).permutation(used)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses, step, steps = [], 0, rounds * PARTS
        for _ in range(rounds):
            for part in np.array_split(order, PARTS):
                if not len(part):
                    continue
                step += 1
                w = counts[part] / total.sum() * PARTS
                n = w.sum(axis=1, keepdims=True)
                x, h, logp = self.forward(part)
                losses.append(float(-(w * logp).sum() / n.sum()))
                dz = np.exp(logp) * n - w
                dh = (dz @ self.p["o"].T) * (1 - h * h)
                dx = dh @ self.p["h"].T
                g = {"o": h.T @ dz, "ob": dz.sum(0), "h": x.T @ dh, "hb": dh.sum(0), **{k: np.zeros_like(self.p[k]) for k in "lrg"}}
                np.add.at(g["l"], part // (CLASSES * GROUPS), dx[:, :WIDTH])
                np.add.at(g["r"], part // GROUPS % CLASSES, dx[:, WIDTH : 2 * WIDTH])
                np.add.at(g["g"], part % GROUPS, dx[:, 2 * WIDTH :])
                lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return losses

    def table(self) -> np.ndarray:
        """log P(class | context) of all contexts, single precision."""
        return np.concatenate([self.forward(np.arange(i, min(i + 4096, CONTEXTS)))[2] for i in range(0, CONTEXTS, 4096)]).astype(np.float32)


class Model:
    """What a task needs to score texts; see score()."""

    def __init__(self, vocabulary: Vocabulary, groups: np.ndarray, network: WindowNetwork):
        self.vocabulary, self.groups, self.table = vocabulary, groups, network.table().ravel()

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text the number of words, the sum of their log-probabilities, and hashes of the words whose log n is to be added."""
        w, first = tokens(texts)
        n, total = np.diff(first), np.zeros(len(texts))
        if not len(w):
            return n, total, [np.zeros(0, np.uint64)] * len(texts)
        h = w.hashes()
        cls, own, join = self.vocabulary.lookup(h, endings(w))
        p = self.table[neighbours(cls, first, self.groups) * CLASSES + cls] + own
        some = np.flatnonzero(n)
        total[some] = np.add.reduceat(p, first[some])
        at = np.flatnonzero(join)
        return n, total, np.split(h[at], np.searchsorted(at, first[1:-1]))


def _counted(texts: DataFrame) -> DataFrame:
    """(h, c, n): hash, class by ending, and count of every word of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs, held = [], [], 0

        def out() -> pa.RecordBatch:
            h, first, n = np.unique(np.concatenate(hs), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(cs)[first].astype(np.int32)), pa.array(n)], ["h", "c", "n"])

        for b in slices(batches):
            w, _ = tokens(b.column(0).cast(pa.binary()).to_pylist())
            hs.append(w.hashes())
            cs.append(endings(w))
            held += len(w)
            if held >= HELD:
                yield out()
                hs, cs, held = [], [], 0
        if held:
            yield out()

    return cut(texts.mapInArrow(count, "h long, c int, n long").groupBy("h").agg(F.min("c").alias("c"), F.sum("n").alias("n")))


def _vocabulary(words: DataFrame, known: int) -> tuple[Vocabulary, DataFrame | None]:
    """The vocabulary, and (h, n) of the words that occur more than once and less often than at most ``known`` words do."""
    step = F.when(F.col("n") < COUNTS, F.col("n")).otherwise(COUNTS + F.floor(F.log2(F.col("n") / COUNTS) * 64)).cast("long")
    reached, least = 0, None
    for at, n in sorted(words.groupBy(step.alias("at")).count().collect(), reverse=True):  # some thousand rows at most
        if reached + n > known:
            break
        reached, least = reached + n, at
    mass = np.zeros(CLASSES, np.int64)
    for c, n in words.groupBy("c").agg(F.sum("n")).collect():
        mass[c] = n
    top = words.where(step >= least if least is not None else F.lit(False)).toArrow()
    h, c, n = (top.column(k).to_numpy() for k in "hcn")
    others = None if least is None and not mass.any() else words.where("n > 1").where(step < least if least is not None else F.lit(True)).select("h", "n")
    bits = None
    if others is not None and others.limit(1).count():
        place = F.shiftrightunsigned("h", 64 - SIEVE_BITS)
        pieces = others.select(F.shiftright(place, 15).alias("p"), place.bitwiseAND(F.lit(32767)).alias("b")).groupBy("p").agg(F.bitmap_construct_agg("b").alias("bits"))
        bits = np.zeros(1 << (SIEVE_BITS - 3), np.uint8)
        for r in pieces.collect():  # 8 MB
            bits[r["p"] * 4096 : (r["p"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return Vocabulary(h.view(np.uint64), c, n, mass, bits), others if bits is not None else None


def _summed(texts: DataFrame, size: int, numbers) -> np.ndarray:
    """How often each of ``size`` numbers occurs, ``numbers`` giving those of some texts; over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in slices(batches):
            n += np.bincount(numbers(b.column(0).cast(pa.binary()).to_pylist()), minlength=size)
        some = np.flatnonzero(n)
        for i in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + (1 << 16)].astype(np.int32)), pa.array(n[some[i : i + (1 << 16)]])], ["k", "n"])

    out = np.zeros(size, np.float64)
    summed = texts.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # ``size`` rows at most
    out[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return out


def fit(texts: DataFrame, known: int = KNOWN) -> tuple[Model, DataFrame | None]:
    """The model of all rows of ``texts`` (text), and (h, n) of words whose counts it doesn't hold; None where there are none."""
    vocabulary, others = _vocabulary(_counted(texts), known)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # some 40 MB at KNOWN words

    def classes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        w, first = tokens(texts)
        return shared.value.lookup(w.hashes(), endings(w))[0], first

    def pairs(texts: list[bytes | None]) -> np.ndarray:
        cls, first = classes(texts)
        inside = np.ones(len(cls), bool)
        inside[first[:-1][first[:-1] < len(cls)]] = False
        at = np.flatnonzero(inside)
        return cls[at - 1] * CLASSES + cls[at]

    groups = grouped(_summed(texts, CLASSES * CLASSES, pairs).reshape(CLASSES, CLASSES))

    def windows(texts: list[bytes | None]) -> np.ndarray:
        cls, first = classes(texts)
        return neighbours(cls, first, groups) * CLASSES + cls

    network = WindowNetwork()
    network.fit(_summed(texts, CONTEXTS * CLASSES, windows).reshape(CONTEXTS, CLASSES))
    return Model(vocabulary, groups, network), others


def _scored(docs: DataFrame, carried: list[str], known: int) -> DataFrame:
    """The columns ``carried`` of ``docs`` with _ql_tokens and _ql_score."""
    spark = docs.sparkSession
    model, others = fit(docs.select(F.col("text").cast("string").alias("text")), known)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, total, rest = shared.value.score(b.column(b.num_columns - 1).cast(pa.binary()).to_pylist())
            hashes = pa.array([r.view(np.int64) for r in rest], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(total), hashes], [*carried, "_ql_tokens", "_ql_score", "_ql_rest"])

    schema = StructType([*docs.select(*carried).schema.fields, StructField("_ql_tokens", LongType()), StructField("_ql_score", DoubleType()), StructField("_ql_rest", ArrayType(LongType()))])
    scored = docs.select(*carried, F.col("text").cast("string").alias("_ql_text")).mapInArrow(run, schema)
    if others is None:
        return scored.drop("_ql_rest")
    rows = cut(scored.withColumn("_ql_row", F.monotonically_increasing_id()))
    each = rows.select("_ql_row", F.explode("_ql_rest").alias("h")).join(others, "h")
    more = F.sum(F.round(F.log("n") / _UNIT).cast("long")) * _UNIT
    added = each.groupBy("_ql_row").agg(more.alias("_ql_more"))
    return rows.join(added, "_ql_row", "left").select(*carried, "_ql_tokens", (F.col("_ql_score") + F.coalesce("_ql_more", F.lit(0.0))).alias("_ql_score"))


def score(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """All columns of ``docs``, with _ql_tokens long and _ql_score double: the sum over all words of a text of
    log P(word | both sides).

    P is a softmax in two steps over all words of the corpus: the network's probability of the word's class given the words
    within REACH on both sides, times the word's share of its class. Shares come from the counts of all words of the corpus,
    and the network is trained on all words of the corpus with their contexts, by counts of (context, class): all passes read
    every document whole. ``known`` words are held by every task; the counts of the others stay in a table that is joined to the words
    of the texts, those that occur once left out (log 1 is 0), so each word has the share that its own count gives it. What reaches
    the driver is bounded by ``known`` words and CONTEXTS * CLASSES counts. Words are compared by 64-bit hashes.

    Null and empty texts have no words and score 0. Repeated rows count and score as often as they stand. Texts may be very long. An
    empty table gives no rows. Columns of ``docs`` named _ql_tokens or _ql_score are replaced.
    """
    docs = docs.drop("_ql_tokens", "_ql_score")
    other = [f"own{c}" if c.lower().startswith("_ql_") else c for c in docs.columns]
    found = _scored(docs.toDF(*other), other, known)
    return found.toDF(*docs.columns, "_ql_tokens", "_ql_score")


def report(docs: DataFrame, known: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and per_token (null without tokens) of every row of ``docs``; see score()."""
    found = _scored(docs.select("doc_id", "text"), ["doc_id"], known)
    n, s = F.col("_ql_tokens"), F.col("_ql_score")
    return found.select("doc_id", n.alias("n_tokens"), s.alias("log_likelihood"), F.when(n > 0, s / n).alias("per_token"))

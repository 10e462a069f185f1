"""Pseudo-likelihood scores: parts and whole against brute force, held-out likelihood against baselines, and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import lm_scoring
from quarryline.llm.lm_scoring import CLASSES, CONTEXTS, GROUPS, REACH, SINGLE, WindowNetwork
from quarryline.llm.wordhash import Table, Words

SF = "/root/testdata/sf0.01"


def test_word_hashes_are_those_of_the_bytes():
    rng = random.Random(1)
    gaps = np.zeros(256, bool)
    gaps[[10, 32]] = True
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    data = " \n ".join(texts).encode()
    w = Words(data, gaps)
    assert [data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)] == data.split()
    by = {}
    assert all(by.setdefault(t, h) == h for t, h in zip(data.split(), w.hashes().tolist(), strict=True)) and len(set(by.values())) == len(by)
    pairs = {}
    at = np.arange(len(w) - 1)
    for i, h in zip(at.tolist(), w.hash(at, at + 1).tolist(), strict=True):
        assert pairs.setdefault(data[w.starts[i] : w.ends[i + 1]], h) == h
    assert len(data) > 3 * (1 << 16) and len(set(pairs.values())) == len(pairs)
    keys = np.array(sorted(by.values()), np.uint64)
    t = Table(keys, np.arange(len(keys)))
    assert np.array_equal(t.values[0][t.find(keys)], np.arange(len(keys))) and (t.find(keys + np.uint64(1)) < 0).all()
    assert len(Words(b"", gaps)) == 0 and len(Words(b" \n", gaps).hashes()) == 0


def test_training_lowers_the_loss_to_the_entropy_of_the_counts():
    counts = np.zeros((CLASSES, CLASSES, GROUPS, CLASSES))
    rng = np.random.default_rng(1)
    for left in range(4):
        for right in range(4):
            counts[left, right, 1, (left * 3 + right) % 7] = 90
            counts[left, right, 1, rng.integers(0, 20)] += 10
    net = WindowNetwork()
    losses = net.fit(counts.reshape(CONTEXTS, CLASSES), rounds=200)
    assert losses[0] > 3 and losses[-1] < 0.6
    table = np.exp(net.table())
    assert np.allclose(table.sum(axis=1), 1, atol=1e-4)
    table = table.reshape(CLASSES, CLASSES, GROUPS, CLASSES)
    assert all(table[i, j, 1].argmax() == (i * 3 + j) % 7 for i in range(4) for j in range(4))


def test_classes_that_stand_together_are_a_group():
    pairs = np.full((CLASSES, CLASSES), 1.0)
    want = np.arange(CLASSES) % GROUPS
    pairs[want[:, None] == want[None, :]] = 50
    got = lm_scoring.grouped(pairs)[1:]
    assert len({(a, b) for a, b in zip(got, want[1:], strict=True)}) == GROUPS


def split(text):
    return (text or "").encode().lower().split()


def ending(word):
    return 1 + SINGLE + (word[-1] * 256 + (word[-2] if len(word) > 1 else 0)) * 40503 % 65521 % lm_scoring.ENDINGS


def around(cls, i, groups):
    """The context of a word, one by one."""
    at = lambda k: cls[k] if 0 <= k < len(cls) else 0
    votes = [0] * GROUPS
    for k in range(2, REACH + 1):
        for c in (at(i - k), at(i + k)):
            if c:
                votes[groups[c]] += 1
    return (at(i - 1) * CLASSES + at(i + 1)) * GROUPS + votes.index(max(votes))


@pytest.mark.parametrize("known", [500, 1 << 20])
def test_scores_are_the_sum_over_all_words(spark, known, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HELD", 10_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "one")], docs.schema))
    got = lm_scoring.report(docs, known).collect()
    texts = [split(r.text) for r in docs.collect()]
    counts = Counter(w for t in texts for w in t)
    top = sorted(counts.items(), key=lambda x: -x[1])
    singles = [w for w, _ in top[:SINGLE]]
    assert top[SINGLE - 1][1] > top[SINGLE][1]  # else ties go by hash
    model, others = lm_scoring.fit(docs.select("text"), known)
    assert (others is not None) == (known == 500)
    order = {int(model.vocabulary.table.values[0][model.vocabulary.table.find(Words(w, lm_scoring._GAPS).hashes())][0]): w for w in singles}
    assert sorted(order) == list(range(1, SINGLE + 1))
    number = {w: c for c, w in order.items()}
    cls = {w: number.get(w) or ending(w) for w in counts}
    mass = Counter()
    for w, n in counts.items():
        mass[cls[w]] += n
    windows = np.zeros((CONTEXTS, CLASSES))
    contexts = []
    for t in texts:
        c = [cls[w] for w in t]
        contexts.append([around(c, i, model.groups) for i in range(len(c))])
        for i, k in enumerate(contexts[-1]):
            windows[k, c[i]] += 1
    net = WindowNetwork()
    net.fit(windows)
    table = net.table()
    want = Counter()
    for t, ks in zip(texts, contexts, strict=True):
        s = sum(float(table[k, cls[w]]) + math.log(counts[w] / mass[cls[w]]) for w, k in zip(t, ks, strict=True))
        want[len(t), round(s / max(1, len(t)), 3)] += 1
    assert len(got) == len(texts)
    near = Counter((r.n_tokens, round(r.log_likelihood / max(1, r.n_tokens), 3)) for r in got)
    assert sum((near - want).values()) <= 0.02 * len(got)  # figures at the border of rounding
    by = {}
    for (n, s), _ in want.items():
        by.setdefault(n, []).append(s)
    assert all(min(abs(r.log_likelihood / max(1, r.n_tokens) - s) for s in by[r.n_tokens]) < 2e-3 for r in got)


def test_held_out_words_are_likelier_than_by_unigrams_and_trigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("doc_id", "text")
    seen, kept = [], []
    for t in docs.dropDuplicates(["text"]).orderBy("doc_id").collect():
        (kept if t.doc_id % 10 == 3 else seen).append(t)
    model, others = lm_scoring.fit(spark.createDataFrame(seen, docs.schema).select("text"))
    assert others is None
    train = [split(r.text) for r in seen]
    uni = Counter(w for t in train for w in t)
    tri, bi, two = Counter(), Counter(), Counter()
    for t in train:
        t = [b"", b"", *t]
        for i in range(2, len(t)):
            tri[tuple(t[i - 2 : i + 1])] += 1
            bi[tuple(t[i - 2 : i])] += 1
            two[tuple(t[i - 1 : i + 1])] += 1
    total = sum(uni.values())
    first = Counter()
    for (a, _), n in two.items():
        first[a] += n
    own, unigram, trigram, mixed, n = 0.0, 0.0, 0.0, 0.0, 0
    for r in kept:
        t = split(r.text)
        if not t:
            continue
        w, at = lm_scoring.tokens([r.text.encode()])
        cls, share, _ = model.vocabulary.lookup(w.hashes(), lm_scoring.endings(w))
        p = model.table[lm_scoring.neighbours(cls, at, model.groups) * CLASSES + cls] + share
        wide = [b"", b"", *t]
        for i, x in enumerate(t):
            if x in uni:  # words that all three can predict
                n += 1
                own += p[i]
                u = uni[x] / total
                unigram += math.log(u)
                a, b = wide[i], wide[i + 1]
                trigram += math.log((tri[a, b, x] + 1) / (bi[a, b] + len(uni)))
                lower = 0.7 * u + 0.3 * (two[b, x] / first[b] if first[b] else u)
                mixed += math.log(0.8 * lower + 0.2 * (tri[a, b, x] / bi[a, b] if bi[a, b] else lower))
    assert n > 10_000
    # mixed, trigrams backed off to bigrams and words, knows the passages that documents share, and is better still
    print("nats a word:", -own / n, -unigram / n, -trigram / n, -mixed / n)
    assert own / n > unigram / n + 0.1 and own / n > trigram / n


def test_shuffled_and_junk_texts_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'").select("doc_id", "text").limit(1500)
    rng = random.Random(1)
    clean = [r for r in docs.limit(40).collect() if r.text and len(r.text.split()) > 30]
    junk = spark.createDataFrame([(10_000_000 + r.doc_id, " ".join("".join(rng.choice("xqzj#%&") for _ in range(6)) for _ in range(60))) for r in clean], "doc_id long, text string")
    got = {r.doc_id: r.per_token for r in lm_scoring.report(docs.unionByName(junk)).collect()}
    ordinary = np.median([got[r.doc_id] for r in clean])
    assert sum(got[10_000_000 + r.doc_id] < ordinary for r in clean) > 0.95 * len(clean)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "two words"), (5, "long " * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2.0, 7) for r in rows], "doc_id long, text string, n_tokens int, _score double, _ql_row int")
    got = sorted((tuple(r) for r in lm_scoring.report(df).collect()), key=str)
    assert len(got) == 7 and sum(r[1] == 0 and r[2] == 0 and r[3] is None for r in got) == 3
    assert all(math.isfinite(r[2]) for r in got) and got.count(next(r for r in got if r[0] == 4)) == 2
    assert lm_scoring.report(df.limit(0)).count() == 0
    for known in (1, 1 << 20):
        scored = lm_scoring.score(df, known)
        assert scored.columns == [*df.columns, "_ql_tokens", "_ql_score"] and {r._ql_row for r in scored.collect()} == {7}

"""Toxicity: model properties, held-out accuracy and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from quarryline.llm import toxicity
from quarryline.llm.toxicity import ClassModels, Scorer

SF = "/root/testdata/sf0.1"


def test_models_prefer_spellings_of_a_class_over_unseen_ones():
    rng = random.Random(2)
    counts = {f"{rng.choice('bcdfgh')}a{rng.choice('lmnp')}e{rng.choice('rst')}o".encode(): (50, 5) for _ in range(60)}
    counts |= {f"zork{e}".encode(): (0, 9) for e in ("en", "a", "ing", "um")}
    m = ClassModels(counts)
    tox, same, unseen = m.ratio([b"zorkib", b"balero", b"\xc3\xa9\xc3\xa8"])
    assert tox > 2 and abs(same) < 1 and tox > unseen + 2
    again = ClassModels.load(m.dump())
    words = list(counts) + [b"x", b"zor", b"\x01\x02"]
    assert np.array_equal(m.ratio(words), again.ratio(words)) and np.isfinite(again.ratio(words)).all()


def test_dropping_single_counts_from_the_tables_changes_nothing():
    """Each probability equals the one worked out from a dictionary of all counts."""
    counts = {b"abab": (3, 1), b"abc": (1, 0), b"b": (0, 4), b"abcabcabc": (2, 2), b"xy": (1, 0), b"yx": (1, 1), b"yy": (1, 2), b"xxy": (3, 1)}
    levels = toxicity.CONTEXTS

    def steps(w):
        s = "^" + w.decode() + "$"
        for i in range(1, len(s)):
            yield [(s[max(0, i - k) : i], s[i]) for k in levels]

    def cut(c, of):
        return min(c, of[0]) if c <= 1 else of[1] if c <= 2 else of[2]

    def estimated(n):
        """Discounts from the counts of counts of one order."""
        of = Counter(c for x in n.values() for c in x.values())
        if not all(of[i] for i in (1, 2, 3, 4)):
            return [1, 1, 1]
        y = of[1] / (of[1] + 2 * of[2])
        return [min(max(v, 0.1), k) for v, k in ((1 - 2 * y * of[2] / of[1], 1), (2 - 3 * y * of[3] / of[2], 2), (3 - 4 * y * of[4] / of[3], 3))]

    def probability(w, y):
        out = 0.0
        for places in steps(w):
            p = 1 / 256
            for k in range(len(levels) - 1):
                seen = {(hi, lo[0], x) for v in counts for at in steps(v) for hi, lo, x in [(at[k + 1][0], at[k], at[k][1])]}
                n = {}
                for _, ctx, x in seen:
                    n.setdefault(ctx, {}).setdefault(x, 0)
                    n[ctx][x] += 1
                p = mix(n.get(places[k][0], {}), places[k][1], p, estimated(n))
            for who in (None, y):
                n = {}
                of = [max(a, b) for a, b in zip(of, (1, 1, 1), strict=True)] if who is not None else None
                for v, c in counts.items():
                    for at in steps(v):
                        w_ = sum(c) if who is None else c[who]
                        if w_:
                            n.setdefault(at[-1][0], {}).setdefault(at[-1][1], 0)
                            n[at[-1][0]][at[-1][1]] += w_
                of = of or estimated(n)
                p = mix(n.get(places[-1][0], {}), places[-1][1], p, of)
            out += math.log(p)
        return out

    def mix(n, x, below, of):
        total = sum(n.values())
        if not total:
            return below
        off = sum(cut(c, of) for c in n.values())
        own = n.get(x, 0)
        return (own - cut(own, of) + off * below) / total

    m = ClassModels(counts)
    for w in (b"abab", b"abc", b"b", b"ab", b"cab", b"q"):
        want = probability(w, 1) - probability(w, 0)
        assert abs(float(m.ratio([w])[0]) - want) < 1e-4


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.report(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.toxic is not None]
    tox, ok = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert sum(r.predicted for r in tox) >= 0.9 * len(tox)
    assert sum(r.predicted for r in ok) <= 0.02 * len(ok)  # 0.01 held for settings that had been chosen on these rows


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "a b"), (-1, None), (-2, ""), (-2, ""), (-3, " \n"), (-4, "idiot " * 50000)], "doc_id long, text string")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    more = spark.createDataFrame([(None, 1), (-1, None), (-2, 0), (-2, 1), (-9, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs.unionByName(odd), labels.unionByName(more)).collect()}
    assert got[None].held_out is False and got[-1].score == got[-2].score == got[-3].score and got[-4].predicted == 1
    assert toxicity.report(docs.limit(0), labels).count() == 0
    none = toxicity.report(odd, labels.limit(0)).collect()
    assert len(none) == 6 and all(r.score == 0 and r.predicted == 0 for r in none)
    wide = odd.selectExpr("doc_id", "text", "'x' as toxic", "'y' as score", "1 as h", "2 as half", "3 as i", "4 as _ql_score", "5 as _ql_toxic")
    kept = toxicity.reject(wide, labels)
    assert kept.columns == wide.columns and kept.count() == 6


def test_the_score_rises_with_the_length_normalised_difference_alone(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    blob, (bias, slope) = toxicity.train(docs, labels)
    assert slope > 0
    models = ClassModels.load(blob)
    texts = [r.text.encode() for r in docs.limit(50).collect()]
    want = []
    for t in texts:
        r = models.ratio(list(set(t.lower().split())))
        want.append(1 / (1 + math.exp(-bias - slope * math.log(np.exp(r).mean()))))
    assert np.allclose(Scorer(models, (bias, slope)).scores(texts), want, atol=1e-9)
    once = Scorer(models, (bias, slope)).differences([b"some words", b"some words " * 1000])
    assert abs(once[0] - once[1]) < 1e-9  # whatever the length


def test_the_same_rows_give_the_same_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(13), labels.repartition(5))
    assert a == b


def test_the_sample_is_bounded_by_bytes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(10**6, "x " * 200_000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    labels = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(10**6, 1)], "doc_id long, toxic int"))
    fitted = toxicity.train(docs, labels, sample_bytes=100_000)
    assert len(fitted[0]) < len(toxicity.train(docs, labels)[0]) / 2
    assert toxicity.train(docs, labels, sample_bytes=1) is None


def test_scorer_forgets_words_but_not_scores():
    s = Scorer(ClassModels({b"ab": (1, 2), b"cd": (3, 1)}), (0.0, 1.0))
    a = s.scores([b"ab cd", None, b""])
    s.known = {str(i).encode(): 0.0 for i in range(500_001)}
    assert np.array_equal(a, s.scores([b"ab cd", None, b""]))

"""Preference formatting and line dedup against brute force in Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import chat, lines

TURN = "conv_id long, turn long, role string, text string, pair_id string, c int, r int"


def brute_preferences(turns, pairs):
    conv = defaultdict(set)
    for c, *t in turns:
        if c is not None:
            conv[c].add(tuple(t))
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    show = lambda ts: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for _, r, x in ts)
    flags = lambda ts: ",".join(f"{len(r or '') + 13}:0,{len(x or '') + 11}:{int(r == 'assistant')}" for _, r, x in ts)
    out = []
    for p, a, b in pairs:
        if a in conv and b in conv:
            x, y = sorted(conv[a], key=key), sorted(conv[b], key=key)
            n = 0
            while n < min(len(x), len(y)) and x[n][1:] == y[n][1:]:
                n += 1
            out.append((p, a, b, n, len(x) - n, len(y) - n, show(x[:n]), show(x[n:]), show(y[n:]), flags(x[n:]), flags(y[n:])))
    return sorted(out)


def test_preferences(spark):
    rng = random.Random(8)
    turns = []
    for c in range(40):
        shared = rng.randint(0, 4)
        for t in range(rng.randint(1, 6)):
            role = ("user", "assistant", None, "system")[t % 4 if t < shared else rng.randrange(4)]
            text = f"t{t}" if t < shared else rng.choice(("é<|x|>", "", None, f"u{rng.random()}"))
            turns.append((c, t, role, text))
    turns += turns[:20] + [(None, 0, "user", "x"), (2, None, None, None), (3, 1, "user", "tie"), (50, 0, "user", "y" * 200_000), (51, 5, "user", "y" * 200_000), (51, 6, "assistant", "z")]
    df = spark.createDataFrame([(*t, "x", 1, 2) for t in turns], TURN)
    pairs = [(k, 2 * k, 2 * k + 1) for k in range(27)] + [(99, 4, 4), (98, 1, 0)]
    got = chat.preferences(df, spark.createDataFrame([(*p, 1) for p in pairs], "pair_id long, chosen_id long, rejected_id long, c int"))
    assert sorted(map(tuple, got.collect())) == brute_preferences(turns, pairs)
    near = chat.preferences(df, chat.neighbours(df))
    assert sorted(map(tuple, near.collect())) == brute_preferences(turns, pairs[:27])
    assert chat.preferences(df.limit(0), chat.neighbours(df.limit(0))).count() == 0


def test_masks_cover_the_rendering(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    for r in chat.preferences(turns, chat.neighbours(turns)).collect():
        for text, runs in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            at, learnt = 0, ""
            for n, flag in re.findall(r"(\d+):(\d)", runs):
                learnt += text[at : at + int(n)] * int(flag)
                at += int(n)
            assert at == len(text)
            said = re.findall(r"<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)", text, re.S)
            assert learnt == "".join(said)


def brute_lines(docs, least=5):
    rows = sorted({(d, h, t) for d, h, t in docs if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    seen, out = [], {}
    for d, h, t in rows:
        kept, removed = [], 0
        parts = t.split("\n")
        for line in parts:
            w = re.findall(r"[^ \t\n\v\f\r]+", line.lower())
            if w and any(near(w, v) if min(len(w), len(v)) >= least else w == v for v in seen):
                removed += 1
            else:
                kept.append(line)
            if w and w not in seen:
                seen.append(w)
        out[d, t] = (len(parts), removed, "\n".join(kept))
    return sorted(((d, *out[d, t]) if t is not None else (d, 0, 0, None) for d, _, t in docs), key=str)


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "a", 1, "k", 5, 6) for d, t in docs], "doc_id long, text string, row string, pos int, w string, _in int, _ql_gone int")
    hashes = [r.h for r in df.select(F.xxhash64("text").alias("h")).collect()]
    want = brute_lines([(d, h, t) for (d, t), h in zip(docs, hashes, strict=True)])
    got = sorted((tuple(r) for r in lines.report(df).collect()), key=str)
    assert got == want
    assert lines.dedup(df).columns == [*df.columns, "_ql_lines", "_ql_removed"]
    return want


def test_line_dedup_on_made_up_lines(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(4, 9))] for _ in range(25)]
    docs = []
    for d in range(60):
        ls = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.4:
                    w[k] = rng.choice("abcxyz")
                elif kind < 0.7:
                    w.insert(k, rng.choice("abcxyz"))
                elif len(w) > 1:
                    del w[k]
            ls.append(rng.choice((" ", "  ", "\t")).join(w) if rng.random() < 0.8 else " " + " ".join(w).upper() + " ")
        docs.append((d, "\n".join(ls)))
    want = run(spark, docs)
    assert sum(r[2] for r in want) > 50


def test_line_dedup_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [
        (1, None), (2, ""), (3, "a b c d e\na b c d e\n\n"), (3, "a b c d e\na b c d e\n\n"), (3, "other text of the same id\nq"), (None, "null id comes first here"),
        (4, "null id comes first here"), (5, "a b c d"), (6, "a b c d"), (7, long), (8, long + " x"), (9, "\n\n"), (10, "Ä b c d é"), (11, "ä b c d É f"),
    ]
    run(spark, docs)
    many = "\n".join(f"line {i % 50_000}" for i in range(100_000))
    wide = " ".join(f"w{i}" for i in range(200_000))
    got = {r.doc_id: r for r in lines.report(spark.createDataFrame([(1, many), (2, wide), (3, wide + " x"), (4, wide[:-9] + " y")], "doc_id long, text string")).collect()}
    assert got[1].n_removed == 50_000 and got[2].n_removed == 0 and got[3].n_removed == 1 and got[4].n_removed == 0
    assert lines.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("group", [400])
def test_line_dedup_of_one_large_group_makes_no_pairs(spark, group):
    docs = [(i, f"one two three four w{i} six seven") for i in range(group)] + [(1000 + i, "exact copy of the same long line") for i in range(group)]
    got = {r.doc_id: r.n_removed for r in lines.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got.values()) == 2 * group - 2 and got[0] == 0 and got[1000] == 0

"""SimHash, decontamination, mixing and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from quarryline.llm import common, decontaminate, mixing, sharding, simhash
from quarryline.llm.common import cut

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, _size string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", "z") for i, t, s in rows], DOC)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (4, "one", "b"), (5, "one", "b"), (None, "one", "b"),
    (6, "é ü \x85  x", "é"), (7, "Word " * 30000, "a"), (8, "a b c d e f g h i j k l", "b"), (9, "A b c d e f g h i j k m", "b"),
]


def brute_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    ids = sorted(fps)
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    x = np.array([fps[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(x[a] ^ x[a + 1 :]) <= distance):
            r, s = sorted((root(i), root(ids[a + 1 + int(b)])))
            top[s] = r
    return {i: root(i) for i in ids}


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want
    kept = [r.doc_id for r in simhash.dedup(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id): r for r in got}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[5].component_id == 4 and by[None].component_id is None and by[None].fingerprint == by[4].fingerprint
    assert by[7].fingerprint == f"{brute_fp('word ' * 30000):016x}"
    kept = Counter(r.doc_id for r in simhash.dedup(frame(spark, ODD)).collect())
    assert kept[4] == 1 and kept[5] == 0 and kept[None] == 1 and kept[1] == 1 and kept[2] == 0
    assert simhash.near_duplicates(frame(spark, ODD).limit(0)).count() == 0


def test_simhash_dedup_is_the_same_without_broadcasts(spark, monkeypatch):
    rows = ODD + [(20 + i, "one two three four five", "a") for i in range(5)]
    few = simhash.dedup(frame(spark, rows))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    many = simhash.dedup(frame(spark, rows))
    joins = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
    assert joins[1].count("BroadcastHashJoin") < joins[0].count("BroadcastHashJoin")  # the sieve's stay
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_simhash_of_few_links_takes_no_rounds(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [*ODD, (20, long, "a"), (21, f"{long} x", "a"), (22, f"{long} y", "b")]
    assert brute_fp(rows[-3][1]) != brute_fp(rows[-1][1])
    want, written, cut_ = {}, [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: written.append(df) or cut_(df))
    for bound in (simhash.ONE_TASK_LINKS, 0):
        monkeypatch.setattr(simhash, "ONE_TASK_LINKS", bound)
        written.clear()
        want[bound] = sorted(map(str, simhash.near_duplicates(frame(spark, rows)).collect())), len(written)
    (one, jobs), (rounds, more) = want.values()
    assert one == rounds and jobs == 1 < more and sum("component_id=20)" in r for r in one) == 3


def test_simhash_does_not_broadcast_a_row_of_each_mask(spark):
    reps = cut(spark.range(5000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep")))
    plan = simhash.link(reps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("tile", [512, 8])
def test_simhash_links_dense_groups_and_chains(spark, tile):
    """A dense group of many different fingerprints, a chain, and random ones; small tiles split them."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 300:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    chain = rng.getrandbits(64)
    for i in range(0, 60, 4):
        chain ^= 0b1111 << i
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    by = dict(enumerate(rng.sample(sorted(fps), len(fps))))
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in by.items()]
    edges = simhash.link(spark.createDataFrame(signed, "fp long, rep long"), 4, tile=tile)
    from quarryline.llm.common import components

    got = {i: i for i in by} | {r.id: r.component for r in components(edges).collect()}
    assert got == brute_components(by)


def brute_hits(docs, items, width=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    lengths = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 3000])
def test_decontaminate(spark, slice_bytes):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in decontaminate.report(docs, bench, slice_bytes=slice_bytes).collect()), key=str)
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got == want and sum(x[-1] for x in want) > 3
    assert decontaminate.clean(docs, bench, slice_bytes=slice_bytes).count() == sum(not x[-1] for x in want)


def test_decontaminate_odd_rows(spark):
    items = [(1, "One"), (2, None), (3, ""), (None, "word"), (4, "b c d e f g h i j k l"), (4, "b c d e f g h i j k l")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, ODD)
    want = brute_hits([(i, t) for i, t, _ in ODD], [x for x in items if x[0] is not None])
    assert sorted((tuple(r) for r in decontaminate.report(docs, bench).collect()), key=str) == want
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())
    cut = {r.doc_id: r.text for r in decontaminate.redact(docs, bench).collect()}
    assert cut[8] == "a " and cut[5] == "" and cut[9] == "A  m" and cut[6] == ODD[7][1]
    assert decontaminate.redact(docs, bench).columns == docs.columns


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def targets(spark, sizes):
    return {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, total long")).collect()}


def test_mixing_targets(spark):
    assert targets(spark, {}) == {}
    t = targets(spark, {"a": 100, "b": 100, None: 100, "c": 0})
    assert t["c"] == 0 and abs(sum(t.values()) - 450) < 1e-9 and t["a"] == t[None] == 450 * 3 / 7  # c has no words: 3, 1 and 3 share
    t = targets(spark, {"a": 10, "b": 1000})
    assert t["a"] == 20 and abs(t["b"] - 1495) < 1e-9


def test_mixing_report(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.report(docs).collect()
    assert len(got) == 1000 and sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(docs.repartition(7)).collect()))
    size, taken, target, most = Counter(), Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    want = brute_targets(dict(size))
    assert target == want
    for s in size:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    rows = Counter(r.doc_id for r in mixing.apply(docs).collect())
    assert all(rows[r.doc_id] * r["size"] == r.taken for r in got)


def test_mixing_odd_rows(spark):
    docs = frame(spark, ODD)
    got = mixing.report(docs).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.report(docs.limit(0)).count() == 0 and mixing.apply(docs.limit(0)).count() == 0
    assert mixing.apply(docs).columns == docs.columns


def test_mixing_of_many_sources_is_joined_with_the_same_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.concat("source", F.col("doc_id") % 40))
    a, b = (sorted(map(tuple, mixing.report(docs, broadcast_sources=n).collect())) for n in (1000, 0))
    assert a == b and len(a) == 1000


def test_mixing_shuffles_no_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (mixing.apply(docs), mixing.report(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_columns_begun_like_our_own_stay(spark):
    odd = frame(spark, ODD).selectExpr("doc_id", "text", "'s' as source", "1 as _ql_size", "2 as _ql_hash", "3 as _ql_spans", "4 as _ql_in", "5 as _ql_row", "6 as _ql_toxic")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    for got in (mixing.apply(odd), simhash.dedup(odd), decontaminate.clean(odd, bench), decontaminate.redact(odd, bench)):
        assert got.columns == odd.columns
        assert {tuple(r)[2:] for r in got.collect()} == {("s", 1, 2, 3, 4, 5, 6)}


def test_dedup_of_rows_that_share_an_id_goes_by_a_total_order(spark):
    rows = [(1, "one two three four five", "b"), (1, "one two three four five", "a"), (1, "one two three four five", "a"), (2, "something else altogether", "c"), (3, "something else altogether", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    got = {tuple(sorted(map(tuple, simhash.dedup(df.repartition(n)).collect()))) for n in (1, 2, 5)}
    assert len(got) == 1 and [r[0] for r in got.pop()] == [1, 2]


def test_tree_weights(spark):
    for shards in (((0, 0.0), (1, 1.0)), ((0, -1.0),), ((0, 1.0), (0, 1.0)), ()):
        with pytest.raises(ValueError):
            sharding.Tree(((shards,),))
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    of = lambda w: {r.doc_id: r.shard for r in sharding.shard(docs, sharding.Tree(((((0, 1.0), (1, w)), ((2, 1.0), (3, 1.0))), (((4, 3.0),),)))).collect()}
    even, heavy = of(1.0), of(3.0)
    moved = [(even[i], heavy[i]) for i in even if even[i] != heavy[i]]
    # within the rack, and into the rack and the region whose weights grew, into shard 1 or along with its rack
    assert moved and all(b in (0, 1) or (a == 4 and b in (2, 3)) for a, b in moved)
    assert abs(sum(s == 4 for s in even.values()) / 4000 - 3 / 7) < 0.03 and abs(sum(s == 1 for s in heavy.values()) / 4000 - 3 / 9) < 0.03


def test_many_copies_of_a_row_take_following_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    df = spark.createDataFrame([(5, "copy")] * 100 + [(i, "own") for i in range(50)] + [(None, None)] * 30, "doc_id long, text string")
    slots = defaultdict(list)
    rows = sharding.shard(df).collect()
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == 180 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = sharding.shard(df.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(frame(spark, ODD).drop("fp", "_size", "shard"))
    text = defaultdict(list)
    got = sharding.shard(docs).collect()
    for r in docs.collect():
        text[r.doc_id].append(r.text)
    slots, shards, moved = defaultdict(list), {}, 0
    for r in got:
        slots[r.shard].append(r.slot)
        assert shards.setdefault(r.doc_id, r.shard) == r.shard and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        moved += r.grown_shard == 8
        assert (r["size"], r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r.doc_id]}
    assert set(slots) == set(range(8)) and 70 < moved < 160
    assert all(sorted(x) == list(range(len(x))) and 80 < len(x) < 175 for x in slots.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_growth_of_any_tree_moves_rows_only_into_the_new_shard(spark):
    from pyspark.sql import functions as F

    tree = sharding.Tree(((((0, 1.0), (1, 3.0)),), (((2, 2.0),), ((3, 1.0), (4, 1.0)))))
    steps = [tree]
    for w in (1.0, 4.0, 2.0):
        steps.append(steps[-1].grown(w))
    rows = spark.range(4000).select(*[t.shard(F.col("id").cast("string")).alias(f"s{i}") for i, t in enumerate(steps)]).collect()
    for i, t in enumerate(steps[:-1]):
        assert all(r[i + 1] in (r[i], t.count()) for r in rows)
    counts = Counter(r[3] for r in rows)
    weight = [1, 3, 2, 1, 1, 1, 4, 2]
    for n, w in enumerate(weight):
        assert abs(counts[n] - 4000 * w / 15) < 5 * (4000 * w / 15) ** 0.5


def test_shards_are_written_with_their_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(frame(spark, ODD).drop("fp", "_size", "shard")).selectExpr("*", "'x' as shard", "1 as _h")
    sharding.write(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    cols = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    digest = Counter(map(tuple, sharding.shard(docs).collect()))
    assert Counter(map(tuple, back.select("doc_id", *(f"_ql_{c}" for c in cols)).collect())) == digest
    assert len(list((tmp_path / "out").glob("_ql_shard=*"))) == 8

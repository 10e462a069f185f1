"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import embeddings
from quarryline.llm.hnsw import Hnsw


def brute(rows, least=0.95):
    """rows: vec_id -> vector (usable ones)."""
    ids = sorted(rows)
    links = {i: set() for i in ids}
    for dim in {len(v) for v in rows.values()}:
        own = [i for i in ids if len(rows[i]) == dim]
        x = np.array([rows[i] for i in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                links[own[a]].add(own[b])
    comp = {}
    for i in ids:
        if i not in comp:
            todo, comp[i] = [i], i
            while todo:
                for j in links[todo.pop()]:
                    if j not in comp:
                        comp[j] = i
                        todo.append(j)
    return {i: (len(links[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_embeddings_table(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute({r.vec_id: r.embedding for r in vectors.collect()})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    kept = [r.vec_id for r in embeddings.dedup(vectors).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]),
        (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [nan, 1.0, 0.0]), (9, [inf, 0.0, 0.0]), (10, [None, 1.0, 0.0]),
        (11, [1.0, 0.0]), (12, [1e-30, 0.0]), (None, [1.0, 0.0, 0.0]), (13, [0.0, 0.0, -5.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, h string, rep int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (5, 6, 7, 8, 9, 10, 13)]
    want += [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (4, 3, 1, False), (11, 1, 11, True), (12, 1, 11, False), (None, 0, None, None)]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def clusters(seed, groups, random, dim=24):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((random, dim))]
    for size in groups:
        parts.append(rng.standard_normal(dim) + 0.03 * rng.standard_normal((size, dim)))
    x = np.concatenate(parts)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_finds_whole_groups_beyond_its_beam():
    x = clusters(3, [1, 40, 700], 1500)
    graph = Hnsw(x[np.random.default_rng(1).permutation(len(x))])
    index = graph.x.astype(np.float64)
    index /= np.linalg.norm(index, axis=1, keepdims=True)
    q, i, beam, recall = embeddings.search(x, graph, index, 0.95)
    want = {tuple(p) for p in np.argwhere(x @ index.T >= 0.95)}
    got = set(zip(q.tolist(), i.tolist(), strict=True))
    assert got <= want and len(got) >= 0.995 * len(want) and beam < len(x) and recall >= embeddings.RECALL


def test_search_falls_back_to_all_rows_where_the_graph_is_broken():
    x = clusters(4, [30, 30], 300)
    graph = Hnsw(x)
    graph.links = [np.full_like(k, -1) for k in graph.links]
    q, i, beam, _ = embeddings.search(x, graph, x, 0.95)
    assert beam == len(x) and len(q) == (x @ x.T >= 0.95).sum()


def halves(seed, pairs, random):
    """Queries and rows: ``pairs`` of the queries have their only link among the rows, all the queries are rows too."""
    x = clusters(seed, [2] * pairs, random)
    asked = np.concatenate((np.arange(min(1, random)), np.arange(random, len(x), 2), np.arange(1, random)))
    return x[asked], x, asked


def test_audit_leaves_out_a_query_itself():
    x, index, asked = halves(5, 3, 2500)
    graph = Hnsw(index)
    # rows of pairs that aren't asked can't be reached: each query finds itself and nothing else
    lost = np.arange(2501, len(index), 2)
    graph.links = [np.where(np.isin(k, lost), -1, k) for k in graph.links]
    ids = np.arange(len(index))
    q, i, _, recall = embeddings.search(x, graph, index, 0.95, asked, ids)
    real = ids[i] != asked[q]
    want = {tuple(p) for p in np.argwhere(x @ index.T >= 0.95) if asked[p[0]] != p[1]}
    assert len(want) == 3 and set(zip(q[real].tolist(), i[real].tolist(), strict=True)) == want and recall == 1.0


def test_recall_is_that_of_a_query_and_not_of_all_links():
    group = clusters(6, [900], 0)
    pairs, _, _ = halves(7, 400, 0)
    index = np.concatenate((group, clusters(7, [2] * 400, 0)))
    graph = Hnsw(index)
    lost = np.arange(901, len(index), 2)
    graph.links = [np.where(np.isin(k, lost), -1, k) for k in graph.links]
    x = np.concatenate((group, pairs))
    asked = np.concatenate((np.arange(900), np.arange(900, len(index), 2)))
    q, i, _, _ = embeddings.search(x, graph, index, 0.95, asked, np.arange(len(index)))
    want = {tuple(p) for p in np.argwhere(x @ index.T >= 0.95)}
    assert set(zip(q.tolist(), i.tolist(), strict=True)) == want


def test_many_shards_and_tasks_find_the_same_links(spark, monkeypatch):
    x = clusters(8, [3, 60, 200], 700)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {i: (n, c) for i, (n, c) in brute(dict(enumerate(x))).items()}
    monkeypatch.setattr(embeddings, "BLOCK", 100)
    got = embeddings.near_duplicates(df, shard_bytes=8 * 24 * 160).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_dedup_keeps_the_same_one_of_rows_of_one_id(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (1, [0.0, 1.0], "c"), (2, [1.0, 0.0], "d"), (None, None, "e"), (None, None, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _ql_id string")
    runs = [sorted(map(str, embeddings.dedup(d).collect())) for d in (df, df.repartition(5), df.orderBy(F.desc("_ql_id")))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 3

"""Connected components and tables in the shared folder."""

import random

from quarryline.llm import common


def brute(edges):
    top = {}

    def root(i):
        top.setdefault(i, i)
        while top[i] != i:
            i = top[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            r, s = sorted((root(a), root(b)))
            top[s] = r
    return {i: root(i) for i in top}


def components(spark, edges):
    rows = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.component for r in rows}


def test_components_of_random_graphs(spark):
    rng = random.Random(12)
    for n, m in ((40, 25), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        assert components(spark, edges) == brute(edges)


def test_components_of_a_long_chain_and_a_hub(spark):
    ids = random.Random(3).sample(range(10_000), 300)
    chain = list(zip(ids, ids[1:], strict=False))
    hub = [(20_000, 20_001 + i) for i in range(2000)]
    assert components(spark, chain + hub) == brute(chain + hub)


def test_loops_nulls_and_repeats(spark):
    edges = [(1, 1), (None, 2), (3, None), (5, 4), (4, 5), (4, 5), (-7, 5)]
    assert components(spark, edges) == brute(edges)
    assert components(spark, []) == {}


def test_only_short_tables_are_broadcast(spark, monkeypatch):
    rng, plans, cut = random.Random(5), [], common.cut
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(common, "cut", seen)
    assert components(spark, edges) == brute(edges)
    assert "BroadcastHashJoin" in "".join(plans)
    plans.clear()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert components(spark, edges) == brute(edges)
    assert "SortMergeJoin" in "".join(plans) and "Broadcast" not in "".join(plans)


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    rng, plans, cut = random.Random(7), [], common.cut
    ids = rng.sample(range(10**12), 400)
    edges = list(zip(ids, ids[1:201], strict=False)) + [(rng.choice(ids), -rng.choice(ids)) for _ in range(150)]
    edges += [(1, 1), (None, 2), (3, None), *edges[:20]]

    def seen(df):
        plans.append(df)
        return cut(df)

    monkeypatch.setattr(common, "cut", seen)
    for one_task, rounds in ((10**6, False), (100, True)):
        plans.clear()
        rows = common.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()
        assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == brute(edges)
        assert (len(plans) > 1) == rounds
    assert common.components(spark.createDataFrame([], "a long, b long"), 10).collect() == []


class Session:
    """As much of a session as shared_dir() asks for."""

    def __init__(self, **settings):
        self.conf = settings


def test_tables_are_written_where_the_session_says(spark):
    assert common.shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    df = common.cut(spark.range(5))
    assert df._ql_path.startswith(common.shared_dir(spark)) and df.count() == 5
    common.drop(df)
    assert not any(p == df._ql_path for _, p in common._WRITTEN)

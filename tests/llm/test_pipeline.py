"""The registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from test_hashing_operators import brute_components, brute_fp, brute_hits, brute_targets

from quarryline.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list:
    text = lambda v: "NULL" if v is None or isinstance(v, float) and v != v else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def digits(text: str, n: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)


def brute_copies(docs):
    """docs: {doc_id: (source, text)}: how often the mix takes each."""
    words = {i: len((t or "").encode().split()) for i, (_, t) in docs.items()}
    total = Counter()
    for i, (s, _) in docs.items():
        total[s] += words[i]
    target = brute_targets(dict(total))
    h = {i: digits(f"{i}:{hashlib.md5((t or '').encode()).hexdigest()}", 15) for i, (_, t) in docs.items()}
    out = {}
    for s in total:
        whole = int(target[s] // total[s])
        rest, upto = target[s] - whole * total[s], 0
        for i in sorted((i for i in docs if docs[i][0] == s), key=h.get):
            take = rest > 0 and (upto + words[i] <= rest or upto <= rest and upto + words[i] - rest < rest - upto)
            upto += words[i]
            out[i] = whole + take
    return out


def brute_shard(key: str, grown: bool) -> int:
    draw = lambda name, weight: -math.log((digits(f"{key}|{name}", 13) + 0.5) / 2**52) / weight
    tops = [(draw(f"r{r}", 4.0), r) for r in range(2)] + ([(draw("+8", 1.0), 8)] if grown else [])
    r = min(tops)[1]
    if r == 8:
        return 8
    k = min((draw(f"r{r}/k{k}", 2.0), k) for k in range(2))[1]
    return min((draw(f"r{r}/k{k}/s{n}", 1.0), n) for n in range(r * 4 + k * 2, r * 4 + k * 2 + 2))[1]


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.source, r.text) for r in table.collect()}
    toxic = {r.doc_id for r in toxicity.report(table, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    kept = [i for i in text if i not in toxic]
    groups = brute_components({i: brute_fp(text[i][1]) for i in kept})
    kept = sorted(set(groups.values()))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_hits([(i, text[i][1]) for i in kept], bench) if r[-1]}
    kept = [i for i in kept if i not in dirty]
    assert toxic and dirty and len(kept) > 500
    copies = brute_copies({i: text[i] for i in kept})

    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    slots = defaultdict(list)
    for r in got:
        t = (text[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        assert (r.shard, r.grown_shard) == (brute_shard(str(r.doc_id), False), brute_shard(str(r.doc_id), True))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-1, "", "en", None, 0), (-2, "word " * 50_000, None, "src0", 1)], table.schema)
    docs = table.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == table.columns and docs.schema == table.schema
    assert docs.count() > 50
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), sf).count() == 0

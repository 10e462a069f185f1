"""The registered query of each operator, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import chat, decontaminate, embeddings, html, lines, lm_scoring, mixing, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


#: Targets: sources in order of cap by weight; those before the level that the rest of the words gives are capped.
@query(
    "op6_mix_sources",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || md5(coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, 2.0::DOUBLE * sum(size)::DOUBLE AS cap FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "BINARY") - 1) % 3 + 1]::DOUBLE AS weight, (SELECT 1.5::DOUBLE * sum(total)::DOUBLE FROM s) AS words FROM s),
l AS (SELECT *, words - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
f AS (SELECT *, rest * weight / left_weight > cap AS capped FROM l),
t AS (SELECT source, total, CASE WHEN capped THEN cap ELSE (words - coalesce((SELECT sum(cap) FROM f WHERE capped), 0)) * weight / (SELECT sum(weight) FROM f WHERE NOT capped) END AS target FROM f),
r AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS own FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, r.total AS source_size, r.target,
       (d.size * (whole + CASE WHEN target > whole * total AND (upto <= target - whole * total OR (upto - own <= target - whole * total AND upto - (target - whole * total) < target - whole * total - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h""",
)
def op6(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"))


@query(
    "op9_decontaminate",
    r"""
WITH tr AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, tr),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, tr WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op9(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op10_shard_hash_tree")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.report(table(spark, d, "documents"), table(spark, d, "labels"))


@query(
    "op8_embedding_near_dedup",
    """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
)
def op8(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, d, "embeddings"))


@query("op2_html_main_text")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(table(spark, d, "pages"))


@query("op7_lm_score")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.report(table(spark, d, "documents"))


@query(
    "op3_preference_format",
    r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
             '<|im_start|>' || coalesce(role, '') || chr(10) AS head, coalesce(text, '') || '<|im_end|>' || chr(10) AS body FROM t),
b AS (SELECT pair_id FROM p GROUP BY pair_id HAVING count(DISTINCT side) = 2),
d AS (SELECT c.pair_id, min(CASE WHEN r.pos IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN c.pos END) - 1 AS n, count(*) AS size
      FROM (SELECT * FROM p WHERE side = 0) c LEFT JOIN (SELECT * FROM p WHERE side = 1) r ON c.pair_id = r.pair_id AND c.pos = r.pos GROUP BY c.pair_id),
x AS (SELECT p.*, coalesce(d.n, d.size) AS n_prefix FROM p JOIN b USING (pair_id) JOIN d USING (pair_id))
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, n_prefix,
       count(*) FILTER (side = 0 AND pos > n_prefix) AS n_chosen, count(*) FILTER (side = 1 AND pos > n_prefix) AS n_rejected,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 0 AND pos <= n_prefix), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix), '') AS rejected,
       coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, ',' ORDER BY pos) FILTER (side = 0 AND pos > n_prefix), '') AS chosen_mask,
       coalesce(string_agg(length(head) || ':0,' || length(body) || ':' || CASE WHEN role = 'assistant' THEN 1 ELSE 0 END, ',' ORDER BY pos) FILTER (side = 1 AND pos > n_prefix), '') AS rejected_mask
FROM x GROUP BY pair_id, n_prefix""",
)
def op3(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return chat.preferences(turns, chat.neighbours(turns))


@query(
    "op4_line_dedup",
    r"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, list_filter(regexp_split_to_array(lower(ls[i]), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
k AS (SELECT w, min({'d': doc_id, 'p': pos}) AS first FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT first, w, len(w) AS n, i, list_concat(w[1:i - 1], w[i + 1:]) AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM k WHERE len(w) >= 5)),
g AS (SELECT DISTINCT a.first FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND a.n = b.n AND b.first < a.first
      UNION SELECT DISTINCT a.first FROM v a JOIN k b ON a.rest = b.w AND len(b.w) >= 5 AND b.first < a.first
      UNION SELECT DISTINCT a.first FROM k a JOIN v b ON a.w = b.rest AND len(a.w) >= 5 AND b.first < a.first),
o AS (SELECT l.doc_id, l.pos, l.line, k.first IS NOT NULL AND (k.first <> {'d': l.doc_id, 'p': l.pos} OR g.first IS NOT NULL) AS gone
      FROM l LEFT JOIN k ON l.w = k.w LEFT JOIN g ON k.first = g.first)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM o GROUP BY doc_id""",
)
def op4(spark: SparkSession, d: str) -> DataFrame:
    return lines.report(table(spark, d, "documents"))

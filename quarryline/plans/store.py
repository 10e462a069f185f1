"""Document store queries over `documents`: source as file, doc_id as position or page."""

from pyspark.sql import functions as F

from quarryline.operators import store as S
from quarryline.plans.registry import query
from quarryline.plans.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


@query("a5_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def a5(spark, d):
    return docs(spark, d).select("doc_id", S.content_hash("text").alias("hash"))


#: Stored: documents in English, with the text of their source's first one; new: those in French.
_OLD = "old AS (SELECT source, doc_id, n_chars FROM documents WHERE lang = 'en')"
_NEW = "new AS (SELECT source, doc_id, n_chars FROM documents WHERE lang = 'fr')"


def _old_new(spark, d):
    cols = ["source", "doc_id", "n_chars"]
    return docs(spark, d).where("lang = 'en'").select(*cols), docs(spark, d).where("lang = 'fr'").select(*cols)


@query("a6_upsert_documents", f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT * FROM new")
def a6(spark, d):
    return S.upsert(*_old_new(spark, d))


@query("a7_batch_upsert_last_wins", f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT source, max(doc_id), arg_max(n_chars, doc_id) FROM new GROUP BY source")
def a7(spark, d):
    return S.upsert_batch(*_old_new(spark, d), order="doc_id")


@query("a8_delete_documents", f"WITH {_OLD} SELECT * FROM old WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) > 20000)")
def a8(spark, d):
    gone = docs(spark, d).groupBy("source").agg(F.max("n_chars").alias("m")).where("m > 20000")
    return S.delete(_old_new(spark, d)[0], gone)


@query("a9_clear_store", f"WITH {_OLD} SELECT * FROM old WHERE false")
def a9(spark, d):
    return S.clear(_old_new(spark, d)[0])


@query("a10_kv_meta", "SELECT source AS key, arg_max(lang, doc_id) AS value FROM documents GROUP BY source")
def a10(spark, d):
    return S.last_wins(docs(spark, d).select(F.col("source").alias("key"), F.col("lang").alias("value"), "doc_id"), "key", order="doc_id").select("key", "value")




@query(
    "a13_change_detection",
    """WITH s AS (SELECT doc_id AS name, CASE WHEN n_chars > 2000 THEN NULL WHEN lang = 'en' THEN sha256(text) ELSE 'other' END AS hash FROM documents WHERE lang <> 'es')
       SELECT doc_id AS name, sha256(text) AS hash FROM documents LEFT JOIN s ON name = doc_id WHERE name IS NULL OR hash IS NULL OR hash <> sha256(text)""",
)
def a13(spark, d):
    found = docs(spark, d).select(F.col("doc_id").alias("name"), S.content_hash("text").alias("hash"))
    h = F.when(F.col("n_chars") > 2000, None).when(F.col("lang") == "en", S.content_hash("text")).otherwise("other")
    stored = docs(spark, d).where("lang <> 'es'").select(F.col("doc_id").alias("name"), h.alias("hash"))
    return S.changed(found, stored)


@query("a14_model_staleness", "SELECT source, count(*) > 0 AND max(lang) IS NOT NULL AND max(lang) <> 'en' AS stale FROM documents GROUP BY source")
def a14(spark, d):
    g = docs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max("lang").alias("stored"))
    return g.select("source", S.model_is_stale(F.col("n"), F.col("stored"), F.lit("en")).alias("stale"))


_CACHE = "cache AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang IN ('en', 'fr'))"


def _texts_cache(spark, d):
    texts = docs(spark, d).select(S.content_hash("text").alias("hash"), "text", F.col("doc_id").alias("pos"))
    cache = docs(spark, d).where("lang in ('en', 'fr')").select(S.content_hash("text").alias("text_hash"), F.lit("m").alias("model"), F.length("text").alias("embedding")).distinct()
    return texts, cache


@query("a17_cache_lookup", f"WITH {_CACHE} SELECT DISTINCT hash, length(text) AS embedding FROM documents JOIN cache ON hash = sha256(text)")
def a17(spark, d):
    return S.cached(*_texts_cache(spark, d), "m")


@query("a18_cache_misses", f"WITH {_CACHE} SELECT sha256(text) AS hash, min(doc_id) AS pos FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM cache) GROUP BY 1")
def a18(spark, d):
    return S.misses(*_texts_cache(spark, d), "m").select("hash", "pos")


@query("a20_store_stats", "SELECT count(DISTINCT source) AS documents, count(*) AS chunks FROM documents")
def a20(spark, d):
    return docs(spark, d).agg(F.countDistinct("source").alias("documents"), F.count("*").alias("chunks"))


@query("a21_document_counts", "SELECT source, max(doc_id) AS page_count, count(*) AS chunk_count FROM documents GROUP BY source")
def a21(spark, d):
    return S.document_counts(docs(spark, d).select("source", F.col("doc_id").alias("page")))


@query(
    "a22_index_run_summary",
    """SELECT count(*) FILTER (lang <> 'es' AND lang <> 'de' AND n_chars // 500 > 0) AS indexed, count(*) FILTER (lang <> 'es' AND (lang = 'de' OR n_chars // 500 = 0)) AS skipped,
              count(*) FILTER (lang = 'es') AS errors, sum(CASE WHEN lang NOT IN ('es', 'de') THEN n_chars // 500 ELSE 0 END)::BIGINT AS total_chunks FROM documents""",
)
def a22(spark, d):
    return S.run_summary(docs(spark, d).select((F.col("lang") == "es").alias("error"), (F.col("lang") == "de").alias("skipped"), F.floor(F.col("n_chars") / 500).alias("chunks")))


@query("a23_first_of_each_text", "SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def a23(spark, d):
    return S.first_of_each(docs(spark, d).select(S.content_hash("text").alias("h"), "doc_id"), "h", "doc_id")


@query("a25_list_documents", "SELECT source, max(ts) AS indexed_at FROM (SELECT event_type AS source, ts FROM events) GROUP BY source ORDER BY indexed_at DESC, source")
def a25(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("indexed_at")).orderBy(F.desc("indexed_at"), "source")


@query("a30_text_hash", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1")
def a30(spark, d):
    return docs(spark, d).groupBy(S.content_hash("text").alias("h")).agg(F.count("*").alias("n"))


@query(
    "b9_extraction_cache",
    """SELECT 'plc:' || md5(event_type || user_id)[1:12] AS key, max(ts) AS at FROM events GROUP BY 1
       HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 1800 SECOND""",
)
def b9(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    entries = e.groupBy(S.cache_key("plc", F.concat("event_type", F.col("user_id").cast("string"))).alias("key")).agg(F.max("ts").alias("at"))
    return S.live(entries.crossJoin(F.broadcast(now)), F.col("now")).select("key", "at")  # one row


@query(
    "c2_upload_dedup",
    """WITH n AS (SELECT doc_id, md5(text)[1:12] AS h, md5(text)[1:12] || '-' || source || '.txt' AS own FROM documents)
       SELECT doc_id AS id, arg_min(own, doc_id) OVER (PARTITION BY h) AS path, own <> arg_min(own, doc_id) OVER (PARTITION BY h) AS reused FROM n""",
)
def c2(spark, d):
    return S.upload_dedup(docs(spark, d).select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("name"), F.col("text").alias("content")))

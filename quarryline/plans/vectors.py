"""Vector search over `embeddings`; the query vector is that of vec_id 0."""

from pyspark.sql import functions as F

from quarryline.operators import vectors as V
from quarryline.plans.registry import query
from quarryline.plans.tables import table

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_D = f"list_distance(embedding::DOUBLE[], {_Q})"


def probe(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def _rounded(df, *more):
    return df.select("vec_id", "label", *more, F.round("distance", 6).alias("distance"))


@query("a19_knn_topk", f"SELECT vec_id, label, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D}, vec_id LIMIT 5")
def a19(spark, d):
    return _rounded(V.knn(table(spark, d, "embeddings"), probe(spark, d), 5))


@query("a12_relevance_ceiling", f"SELECT vec_id, label, round(x, 6) AS distance FROM (SELECT *, {_D} AS x FROM embeddings ORDER BY x, vec_id LIMIT 20) WHERE x <= 1.2")
def a12(spark, d):
    return _rounded(V.knn(table(spark, d, "embeddings"), probe(spark, d), 20, max_distance=1.2))


@query("a16_filter_below_topk", f"SELECT vec_id, label, round({_D}, 6) AS distance FROM embeddings WHERE label = (SELECT max(label) FROM embeddings) ORDER BY {_D}, vec_id LIMIT 5")
def a16(spark, d):
    e = table(spark, d, "embeddings")
    top = e.agg(F.max("label").alias("label"))
    return _rounded(V.knn(e, probe(spark, d), 5, only=e.join(F.broadcast(top), "label", "left_semi")))  # one row


@query(
    "a15_hits_with_documents",
    f"""SELECT h.vec_id, h.label, doc_id, source, lang, round(x, 6) AS distance
        FROM (SELECT *, {_D} AS x FROM embeddings ORDER BY x, vec_id LIMIT 10) h JOIN documents ON doc_id = h.vec_id""",
)
def a15(spark, d):
    chunks = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("doc_id"))
    hits = V.knn(table(spark, d, "embeddings"), probe(spark, d), 10)
    return _rounded(V.with_documents(hits, chunks, table(spark, d, "documents").select("doc_id", "source", "lang")), "doc_id", "source", "lang")


@query(
    "a24_knn_batch",
    """SELECT q, vec_id, round(x, 6) AS distance, rank FROM (
         SELECT a.vec_id AS q, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id)::INT AS rank
         FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b) WHERE rank <= 3""",
)
def a24(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"))
    return V.knn_batch(e.select("vec_id", "embedding"), queries, 3).select("q", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "a32_relevance_label",
    f"SELECT vec_id, CASE WHEN x = 0 THEN '' ELSE printf('%.2f', 1 - x) END AS relevance FROM (SELECT vec_id, {_D} AS x FROM embeddings ORDER BY x, vec_id LIMIT 50)",
)
def a32(spark, d):
    return V.knn(table(spark, d, "embeddings"), probe(spark, d), 50).select("vec_id", V.relevance(F.col("distance")).alias("relevance"))


@query("a11_dimension_check", "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def a11(spark, d):
    """Vector lengths: a store whose lengths differ from the configured one is rebuilt."""
    return table(spark, d, "embeddings").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))

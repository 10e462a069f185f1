"""Log and stream queries over `events` and `conversations`: event types as sources and states."""

from pyspark.sql import functions as F

from quarryline.operators import usage as U
from quarryline.plans.registry import query
from quarryline.plans.tables import table
from quarryline.sources import logs
from quarryline.streaming import index as I
from quarryline.streaming import logs as L


def events(spark, d):
    return table(spark, d, "events").withColumn("id", F.col("event_id")).withColumn("source", F.col("event_type"))


@query("f1_json_log_lines", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS value FROM events""")
def f1(spark, d):
    return logs.json_lines(table(spark, d, "events").select("event_id", "event_type", "user_id"))


@query("f3_bounded_ring", "SELECT event_type AS source, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def f3(spark, d):
    return L.ring(events(spark, d), 100).select("source", "id")


@query("f4_replay_then_follow", "SELECT event_id AS id, CASE WHEN value < 5 THEN 0 ELSE 1 END AS phase FROM events")
def f4(spark, d):
    e = events(spark, d).select("id", "value")
    return L.replay_then_follow(e.where("value < 5"), e).select("id", "phase")


@query("f5_subscribed_sources", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def f5(spark, d):
    e = events(spark, d)
    return L.subscribed(e, ["error", "click"], e).select("event_id", "event_type")


@query("f6_sources_at_end", "SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase' AND user_id IN (1, 2, 3)) = 3 AS done")
def f6(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("state"))
    return L.all_reached(e, ["1", "2", "3"], "purchase")


@query("f7_event_envelope", """SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS place, event_id AS at, 'data: ' || props || chr(10) || chr(10) AS line FROM events UNION ALL SELECT 2, 0, 'data: [DONE]' || chr(10) || chr(10)""")
def f7(spark, d):
    return L.enveloped(table(spark, d, "events"), "props", "event_id", F.col("event_type") == "error")


@query("f8_merged_chunks", "SELECT conv_id AS id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING bool_or(turn >= 3)")
def f8(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "text", (F.col("turn") >= 3).alias("finished"))
    return L.merged_chunks(c)


@query(
    "f9_time_to_first_token",
    "SELECT stream, (min(us) FILTER (event_type <> 'view') - min(first)) AS micros FROM (SELECT user_id AS stream, event_type, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY stream",
)
def f9(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") != "view", "x").otherwise("").alias("content"))
    started = e.groupBy("stream").agg(F.min("ts").alias("started"))
    return U.first_token_times(e.join(started, "stream")).withColumnRenamed("ttft", "micros")


@query(
    "f10_event_routes",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'tool_calls' WHEN 'purchase' THEN 'progress' WHEN 'signup' THEN 'message_info' ELSE 'error' END AS type FROM events",
)
def f10(spark, d):
    t = F.col("event_type")
    mode = F.when(t == "view", "messages").when(t == "click", "updates").when(t == "purchase", "custom").when(t == "signup", "values").otherwise("-")
    return table(spark, d, "events").select("event_id", L.route(mode, F.lit("user")).alias("type"))


@query(
    "f12_index_maintenance",
    """WITH i AS (SELECT conv_id * 100 + turn AS id, conv_id AS chat_id, text AS content FROM conversations)
       SELECT id, chat_id, CASE WHEN chat_id % 3 = 0 THEN 'renamed' ELSE 'old' END AS title, CASE WHEN id % 2 = 0 THEN 'new' ELSE content END AS content FROM i WHERE id % 5 <> 0""",
)
def f12(spark, d):
    """Every message is indexed, then each fifth deleted, of the others each second changed, and titles renamed."""
    i = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), F.lit("old").alias("title"), F.col("text").alias("content"))
    gone = i.where("id % 5 = 0").select(F.lit(2).alias("seq"), F.lit("delete").alias("op"), "*")
    new = i.where("id % 2 = 0").select(F.lit(1).alias("seq"), F.lit("upsert").alias("op"), "id", "chat_id", "title", F.lit("new").alias("content"))
    named = i.where("chat_id % 3 = 0").select(F.lit(3).alias("seq"), F.lit("title").alias("op"), "id", "chat_id", F.lit("renamed").alias("title"), "content")
    return I.applied(i, gone.unionByName(new).unionByName(named))


@query("f_ext_tumbling_windows", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    """An extension: the reference has no event-time windows."""
    return L.tumbling(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "f_ext_session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_windows(spark, d):
    """An extension."""
    return L.sessions(table(spark, d, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})

"""Conversation store, usage and search queries: orders and line items as chats and messages."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators import conversations as C
from quarryline.operators import fulltext as T
from quarryline.operators import usage as U
from quarryline.plans.registry import query
from quarryline.plans.tables import CHATS_SQL, MESSAGES_SQL, chats, messages, table

_CM = f"WITH {CHATS_SQL}, {MESSAGES_SQL} "


@query("c1_insert_or_ignore", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE role = 'system'")
def c1(spark, d):
    t = table(spark, d, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    old, new = t.where("role <> 'system'").select("key", "conv_id", "turn", "role"), t.select("key", "conv_id", "turn", F.lit("new").alias("role"))
    return C.insert_new(old, new, "key").drop("key")


@query("c3_user_scope", f"WITH {CHATS_SQL} SELECT 'none' AS who, count(*) AS n FROM chats WHERE user_id IS NULL UNION ALL SELECT '7', count(*) FROM chats WHERE user_id = 7")
def c3(spark, d):
    c = chats(spark, d)
    one = lambda who, user: c.where(C.owned_by(user)).agg(F.lit(who).alias("who"), F.count("*").alias("n"))
    return one("none", F.lit(None).cast("long")).unionByName(one("7", F.lit(7)))


@query("c4_delete_many", f"WITH {CHATS_SQL} SELECT id, coalesce(user_id, -1) AS user_id FROM chats WHERE NOT (id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND user_id IS NULL)")
def c4(spark, d):
    ids = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return C.delete_many(chats(spark, d), ids, F.lit(None).cast("long")).select("id", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query("c5_exists", f"WITH {CHATS_SQL} SELECT EXISTS (SELECT 1 FROM chats WHERE id = 3) AS found")
def c5(spark, d):
    return C.exists(chats(spark, d), F.col("id") == 3)


@query(
    "c6_patch_chat",
    f"WITH {CHATS_SQL} SELECT id, CASE WHEN user_id IS NULL THEN 'patched' ELSE title END AS title, CASE WHEN user_id IS NULL THEN NULL ELSE starred_at END AS starred_at, CASE WHEN user_id IS NULL THEN created_at END AS updated_at FROM chats",
)
def c6(spark, d):
    return C.patched(chats(spark, d), F.col("user_id").isNull(), F.col("created_at"), F.lit("patched"), star=False).select("id", "title", "starred_at", "updated_at")


@query("c7_message_files", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '["a.png","' || turn || '.txt"]' ELSE '' END AS files FROM conversations""")
def c7(spark, d):
    t = table(spark, d, "conversations")
    docs = F.array(F.concat(F.col("turn").cast("string"), F.lit(".txt")))
    return C.with_files(t, F.col("role") == "user", F.array(F.lit("a.png")), docs).select("conv_id", "turn", "files")


@query("c9_chats_with_messages", _CM + "SELECT c.id, coalesce(m.id, -1) AS message_id FROM chats c LEFT JOIN messages m ON m.chat_id = c.id")
def c9(spark, d):
    m = messages(spark, d).select(F.col("chat_id").alias("id"), F.col("id").alias("message_id"))
    return chats(spark, d).select("id").join(m, "id", "left").select("id", F.coalesce("message_id", F.lit(-1)).alias("message_id"))


_ROWS = "SELECT m.*, c.title, c.user_id, max(m.created_at) OVER (PARTITION BY m.chat_id) AS last_message_at FROM messages m JOIN chats c ON c.id = m.chat_id"


@query("c10_messages_chats_last", _CM + f"SELECT id, chat_id, title, last_message_at FROM ({_ROWS})")
def c10(spark, d):
    return C.search_rows(chats(spark, d), messages(spark, d)).select("id", "chat_id", "title", "last_message_at")


@query("c13_loaded_chats", _CM + "SELECT c.id, count(m.id) AS n, coalesce(string_agg(m.id || m.role, ',' ORDER BY m.id), '') AS ids FROM chats c LEFT JOIN messages m ON m.chat_id = c.id GROUP BY c.id")
def c13(spark, d):
    loaded = C.loaded(chats(spark, d), messages(spark, d).select("id", "chat_id", "role"))
    ids = F.array_join(F.transform("messages", lambda m: F.concat(m["id"].cast("string"), m["role"])), ",")
    return loaded.select("id", F.size("messages").cast("long").alias("n"), ids.alias("ids"))


@query("c14_last_message_time", f"WITH {MESSAGES_SQL} SELECT chat_id, max(created_at) AS last_message_at FROM messages GROUP BY chat_id")
def c14(spark, d):
    return C.last_message_times(messages(spark, d))


@query("c15_chat_activity", _CM + "SELECT c.id, coalesce(max(m.created_at), c.created_at) AS last_at FROM chats c LEFT JOIN messages m ON m.chat_id = c.id GROUP BY c.id, c.created_at")
def c15(spark, d):
    return C.with_activity(chats(spark, d), messages(spark, d)).select("id", "last_at")


@query(
    "c16_usage_rollup",
    f"""WITH {MESSAGES_SQL} SELECT chat_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, coalesce(arg_min(ttft, id * 1000 + ttft) FILTER (ttft > 0), 0) AS ttft,
        coalesce(sum(CASE WHEN output_tokens > 0 THEN tps * output_tokens END)::DOUBLE / sum(CASE WHEN output_tokens > 0 THEN output_tokens END)::DOUBLE, 0) AS tps FROM messages GROUP BY chat_id""",
)
def c16(spark, d):
    return U.rolled_up(messages(spark, d)).withColumn("ttft", F.coalesce("ttft", F.lit(0)))


@query("c17_message_speed", f"WITH {MESSAGES_SQL} SELECT id, CASE WHEN ttft > 0 THEN output_tokens / ttft ELSE 0 END AS tps FROM messages")
def c17(spark, d):
    return messages(spark, d).select("id", U.speed(F.col("output_tokens"), F.col("ttft")).alias("tps"))


@query("c18_starred_partition", f"WITH {CHATS_SQL} SELECT CASE WHEN starred_at IS NOT NULL THEN 'starred' ELSE 'normal' END AS section, count(*) AS n FROM chats GROUP BY 1")
def c18(spark, d):
    return C.by_star(chats(spark, d)).groupBy("section").agg(F.count("*").alias("n"))


@query("c20_chat_list_order", _CM + "SELECT id, row_number() OVER (ORDER BY starred_at DESC NULLS LAST, last_at DESC NULLS LAST, id) AS place FROM (SELECT c.id, c.starred_at, coalesce(max(m.created_at), c.created_at) AS last_at FROM chats c LEFT JOIN messages m ON m.chat_id = c.id GROUP BY c.id, c.starred_at, c.created_at) QUALIFY place <= 50")
def c20(spark, d):
    """The first page of the list: its 50 rows."""
    page = C.listed(C.with_activity(chats(spark, d), messages(spark, d)))
    return page.limit(50).select("id", F.row_number().over(W.orderBy(F.desc_nulls_last("starred_at"), F.desc_nulls_last("last_at"), "id")).cast("long").alias("place"))


@query("c21_search_order", _CM + f"SELECT id, chat_id, last_message_at FROM ({_ROWS}) WHERE title ILIKE '%urgent%' ORDER BY last_message_at DESC, created_at, id")
def c21(spark, d):
    rows = C.search_rows(chats(spark, d), messages(spark, d))
    return T.ordered(rows.where(T.like("urgent", [F.col("title")]))).select("id", "chat_id", "last_message_at")


@query("c22_next_reply", f"WITH {MESSAGES_SQL} SELECT u.id, coalesce(min(a.id), -1) AS reply_id FROM messages u LEFT JOIN messages a ON a.chat_id = u.chat_id AND a.role = 'assistant' AND a.id > u.id WHERE u.role = 'user' GROUP BY u.id")
def c22(spark, d):
    return C.next_reply(messages(spark, d)).withColumn("reply_id", F.coalesce("reply_id", F.lit(-1))).distinct()


@query("c23_delete_after_anchor", f"WITH {MESSAGES_SQL}, a AS (SELECT chat_id, min(id) AS anchor_id FROM messages GROUP BY chat_id) SELECT m.id FROM messages m JOIN a USING (chat_id) JOIN messages x ON x.id = a.anchor_id WHERE m.created_at > x.created_at")
def c23(spark, d):
    m = messages(spark, d)
    return C.after_anchor(m, m.groupBy("chat_id").agg(F.min("id").alias("anchor_id"))).select("id")


#: Conversations as messages: a chat's title is its first text's first 40 characters.
_S = """t AS (SELECT conv_id AS chat_id, conv_id * 100 + turn AS id, turn AS created_at, text AS content, role FROM conversations),
s AS (SELECT *, first_value(content[1:40]) OVER (PARTITION BY chat_id ORDER BY id) AS title, max(created_at) OVER (PARTITION BY chat_id) AS last_message_at FROM t)"""


def searched(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("chat_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("created_at"), F.col("text").alias("content"), "role")
    by = t.groupBy("chat_id").agg(F.substring(F.min_by("content", "id"), 1, 40).alias("title"), F.max("created_at").alias("last_message_at"))
    return t.join(by, "chat_id")


def _columns():
    return {"chat_id": F.col("chat_id").cast("string"), "title": F.col("title"), "content": F.col("content")}


def _has(term):
    return f"(contains(lower(chat_id::VARCHAR), '{term}') OR contains(lower(title), '{term}') OR contains(lower(content), '{term}'))"


@query("c11_fts_terms", f"WITH {_S} SELECT id, chat_id FROM s WHERE {_has('tion')} AND {_has('the')}")
def c11(spark, d):
    return searched(spark, d).where(T.matches("Tion the", _columns())).select("id", "chat_id")


@query("c11_fts_phrase_or_not", f"WITH {_S} SELECT id FROM s WHERE ({_has('of the')} OR {_has('ouea')}) AND NOT contains(lower(title), 'tion')")
def c11b(spark, d):
    return searched(spark, d).where(T.matches('("of the" OR ouea) NOT title : tion', _columns())).select("id")


@query("c11_fts_syntax_fallback", f"WITH {_S} SELECT id FROM s WHERE title ILIKE '%t,%e%' OR content ILIKE '%t,%e%'")
def c11c(spark, d):
    return searched(spark, d).where(T.matches("t,%e", _columns())).select("id")


@query("c12_like_search", f"WITH {_S} SELECT id FROM s WHERE title ILIKE '%ti_n of%' OR content ILIKE '%ti_n of%'")
def c12(spark, d):
    return searched(spark, d).where(T.matches("ti_n of", _columns(), dialect="like")).select("id")


@query("c19_first_hit_per_chat", f"WITH {_S} SELECT chat_id, min(id) AS id FROM s WHERE content ILIKE '%tion%' OR title ILIKE '%tion%' GROUP BY chat_id")
def c19(spark, d):
    return T.first_hits(searched(spark, d).where(T.matches("tion", _columns(), dialect="like"))).select("chat_id", "id")


@query(
    "c24_snippet",
    r"""WITH p AS (SELECT conv_id, turn, text, length(text) AS n, greatest(strpos(lower(text), 'tion') - 1, 0) AS m FROM conversations),
        q AS (SELECT *, least(n, greatest(m - 15, 0) + 30) AS e FROM p), r AS (SELECT *, greatest(e - 30, 0) AS b FROM q)
        SELECT conv_id, turn, CASE WHEN b > 0 THEN '...' ELSE '' END || regexp_replace(text[b + 1:e], '(?i)(tion)', '<b>\1</b>', 'g') || CASE WHEN e < n THEN '...' ELSE '' END AS snippet FROM r""",
)
def c24(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.snippet(F.col("text"), "tion", 30).alias("snippet"))

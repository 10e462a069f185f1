"""Message sequence queries over `conversations`."""

from pyspark.sql import functions as F

from quarryline.operators import sequences as Q
from quarryline.plans.registry import query
from quarryline.plans.tables import table

_TOK = "(ceil(length(text) / 4.0) + 3)::BIGINT"
_CUM = f"sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC)"
_LAST = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"


def turns(spark, d):
    return table(spark, d, "conversations")


@query("e1_removed_messages", f"SELECT conv_id, turn FROM (SELECT *, {_CUM} <= 300 OR {_LAST} AS kept FROM conversations) WHERE NOT kept")
def e1(spark, d):
    t = turns(spark, d)
    return Q.removed(t, Q.suffix_window(t, 300).where("kept"), "conv_id", "turn").select("conv_id", "turn")


@query("e2_suffix_window", f"SELECT conv_id, turn, {_TOK} AS tokens, {_CUM} <= 200 OR {_LAST} AS kept FROM conversations")
def e2(spark, d):
    return Q.suffix_window(turns(spark, d), 200).select("conv_id", "turn", "tokens", "kept")


_NUM = "num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
_CUT = "coalesce(max(i) FILTER (role = 'user' AND i >= 1 AND i <= least({t}, n - 1)), max(i) FILTER (role <> 'tool' AND i >= 1 AND i <= least({t}, n - 1)), 0)::INT"


@query("e3_safe_cut", f"WITH {_NUM} SELECT conv_id, {_CUT.format(t='n // 2')} AS cut FROM num GROUP BY conv_id")
def e3(spark, d):
    return Q.safe_cut(turns(spark, d), F.expr("n div 2"))


@query(
    "e2_compaction",
    f"""WITH k AS (SELECT *, {_TOK} AS tok, {_CUM} <= 150 OR {_LAST} AS kept FROM conversations), {_NUM.replace('conversations', 'k')},
        o AS (SELECT *, sum(tok) OVER (PARTITION BY conv_id) AS total, count(*) FILTER (NOT kept) OVER (PARTITION BY conv_id) AS old FROM num)
        SELECT conv_id, max(total)::BIGINT AS total, {_CUT.format(t='old')} AS cut FROM o WHERE total > 400 GROUP BY conv_id""",
)
def e2b(spark, d):
    return Q.compaction(turns(spark, d), 500)


@query("e4_trim_to_tokens", f"SELECT conv_id, count(*) AS n, min(turn) AS first FROM (SELECT *, {_CUM} <= 250 OR {_LAST} AS kept FROM conversations) WHERE kept GROUP BY conv_id")
def e4(spark, d):
    return Q.suffix_window(turns(spark, d), 250).where("kept").groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"))


def _with_calls(t):
    calls = F.when(F.col("role") == "assistant", F.array(F.concat_ws("-", "conv_id", "turn", F.lit("a")), F.concat_ws("-", "conv_id", "turn", F.lit("b")))).otherwise(F.array().cast("array<string>"))
    return t.withColumn("calls", calls).withColumn("call_id", F.lit(None).cast("string"))


@query(
    "e5_gap_repair",
    """WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
       SELECT conv_id, turn, 0 AS place, role, NULL AS call_id FROM conversations
       UNION ALL SELECT conv_id, turn, i, 'tool', conv_id || '-' || turn || '-' || CASE i WHEN 1 THEN 'a' ELSE 'b' END FROM n, (VALUES (1), (2)) v(i) WHERE role = 'assistant' AND nxt IS NOT NULL AND nxt <> 'tool'""",
)
def e5(spark, d):
    return Q.gap_repair(_with_calls(turns(spark, d))).drop("text")


@query(
    "e5b_cancel_unanswered",
    """SELECT conv_id, turn, 0 AS place, CASE WHEN role = 'system' THEN 'tool' ELSE role END AS role FROM conversations
       UNION ALL SELECT c.conv_id, c.turn, i, 'tool' FROM conversations c, (VALUES (1), (2)) v(i) WHERE c.role = 'assistant'
       AND NOT (i = 1 AND c.turn = 1 AND EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system'))""",
)
def e5b(spark, d):
    """System messages answer the first call of turn 1 of their conversation."""
    t = _with_calls(turns(spark, d))
    answer = F.col("role") == "system"
    t = t.withColumn("call_id", F.when(answer, F.concat_ws("-", "conv_id", F.lit("1"), F.lit("a")))).withColumn("role", F.when(answer, "tool").otherwise(F.col("role")))
    return Q.cancel_unanswered(t).select("conv_id", "turn", "place", "role")


@query("e6_fill_empty", "SELECT conv_id, turn, CASE WHEN role = 'system' OR length(text) > 60 THEN CASE WHEN length(text) > 60 THEN '' ELSE text END ELSE text END || CASE WHEN role <> 'system' AND length(text) > 60 THEN ' ' ELSE '' END AS text FROM conversations")
def e6(spark, d):
    t = turns(spark, d).withColumn("text", F.when(F.length("text") > 60, "").otherwise(F.col("text")))
    return t.select("conv_id", "turn", Q.fill_empty(F.col("role"), F.col("text")).alias("text"))


_RE = "length(text) % 5 = 0"


@query("e7_resend", f"SELECT conv_id, turn FROM (SELECT *, {_RE} AS again, coalesce(max(CASE WHEN {_RE} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after FROM conversations) WHERE again OR NOT after")
def e7(spark, d):
    return Q.resend(turns(spark, d), F.length("text") % 5 == 0).select("conv_id", "turn")


@query("e8_current_turn", "SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE turn >= l")
def e8(spark, d):
    return Q.current_turn(turns(spark, d)).select("conv_id", "turn", "role")


@query(
    "e9_truncate_tool_results",
    """SELECT doc_id, CASE WHEN length(text) > 1000 THEN text[1:1000] || chr(10) || chr(10) || '... [TRUNCATED: ' || format('{:,}', length(text)) || ' chars total, showing first 1,000. Use specific tool calls to get details on individual items.]' ELSE text END AS text FROM documents""",
)
def e9(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.truncated(F.col("text"), 1000).alias("text"))


@query(
    "e11_summary_input",
    """WITH l AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN '[System: ' || CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END || ']'
         WHEN 'user' THEN 'User: ' || CASE WHEN length(text) > 2000 THEN text[1:2000] || '...' ELSE text END
         WHEN 'assistant' THEN CASE WHEN trim(text) <> '' THEN 'Assistant: ' || CASE WHEN length(text) > 1000 THEN text[1:1000] || '...' ELSE text END END END AS line FROM conversations)
       SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS conversation FROM l WHERE line IS NOT NULL GROUP BY conv_id""",
)
def e11(spark, d):
    return Q.summary_input(turns(spark, d))


@query(
    "e12_context_window",
    """SELECT p_partkey, CASE WHEN m = 'gpt-4' THEN 8000 WHEN m LIKE '%[1m]' THEN 1000000 WHEN m LIKE 'claude-3%' THEN 200000 WHEN m LIKE 'Gemini%' THEN 1000000 ELSE 128000 END::BIGINT AS tokens
       FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'gpt-4' WHEN p_size < 20 THEN 'glm-5[1m]' WHEN p_size < 30 THEN 'claude-3-x' WHEN p_size < 40 THEN 'Gemini-p' ELSE p_name END AS m FROM part)""",
)
def e12(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    model = F.when(size < 10, "gpt-4").when(size < 20, "glm-5[1m]").when(size < 30, "claude-3-x").when(size < 40, "Gemini-p").otherwise(F.col("p_name"))
    return p.select("p_partkey", Q.context_window(model).alias("tokens"))


@query("e13_approximate_tokens", f"SELECT conv_id, sum({_TOK})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def e13(spark, d):
    return turns(spark, d).groupBy("conv_id").agg(F.sum(Q.approximate_tokens(F.col("text"))).alias("tokens"))

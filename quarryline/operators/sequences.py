"""Transforms of message sequences: (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shares of a context window that start compaction and that recent messages keep.
COMPACT_AT, KEEP_RECENT = 0.80, 0.30
#: Characters of each role that a summary sees; of a tool result that a model sees.
SUMMARY_CAPS = {"system": 200, "user": 2000, "assistant": 1000, "tool": 500}
TOOL_RESULT_CAP = 40_000
#: Input tokens of models by exact name, then by the first part of a name that is contained.
CONTEXT_WINDOWS = {"gpt-4o": 128_000, "gpt-4o-mini": 128_000, "gpt-4-turbo": 128_000, "gpt-4": 8_000, "gpt-3.5-turbo": 16_000, "o1": 200_000, "o1-mini": 128_000, "o3-mini": 200_000}
CONTEXT_FAMILIES = (
    ("gpt-4", 128_000), ("gpt-3.5", 16_000), ("claude-3", 200_000), ("claude-opus", 200_000), ("claude-sonnet", 200_000), ("glm-4", 128_000), ("glm-5", 128_000),
    ("deepseek", 128_000), ("o1-", 200_000), ("o3-", 200_000), ("gemini", 1_000_000),
)
CONTEXT_DEFAULT = 128_000


def approximate_tokens(text: Column, per_message: int = 3) -> Column:
    """Our own estimate: a token for each four characters, rounded up, and ``per_message``."""
    return (F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4) + per_message).cast("long")


def _ordered(*more: Column):
    return W.partitionBy("conv_id").orderBy("turn", *more)


def numbered(messages: DataFrame) -> DataFrame:
    """With i (0-based place) and n (messages) of each conversation."""
    return messages.withColumn("i", F.row_number().over(_ordered()) - 1).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))


def suffix_window(messages: DataFrame, budget: Column | int, tokens: Column | None = None) -> DataFrame:
    """With kept: whether a message is in the longest run of last messages with at most ``budget`` tokens; the
    last one always is."""
    cost = approximate_tokens(F.col("text")) if tokens is None else tokens
    back = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))) == 1
    return messages.withColumn("tokens", cost).withColumn("kept", (F.sum("tokens").over(back) <= limit) | last)


def safe_cut(messages: DataFrame, target: Column) -> DataFrame:
    """(conv_id, cut): the place at which a conversation may be cut, at ``target`` (an expression over n) or before:
    the last user message, else the last that is no tool result, else 0. Place 0 is never chosen as such."""
    m = numbered(messages).withColumn("_t", F.least(target, F.col("n") - 1))
    inside = (F.col("i") >= 1) & (F.col("i") <= F.col("_t"))
    user = F.max(F.when(inside & (F.col("role") == "user"), F.col("i")))
    other = F.max(F.when(inside & (F.coalesce("role", F.lit("")) != "tool"), F.col("i")))
    return m.groupBy("conv_id").agg(F.coalesce(user, other, F.lit(0)).alias("cut"))


def compaction(messages: DataFrame, window: int) -> DataFrame:
    """(conv_id, total, cut): conversations over the threshold and the place before which they are summarised."""
    m = suffix_window(messages, int(window * KEEP_RECENT))
    w = W.partitionBy("conv_id")
    m = m.withColumn("total", F.sum("tokens").over(w)).where(F.col("total") > int(window * COMPACT_AT))
    m = m.withColumn("_old", F.sum((~F.col("kept")).cast("int")).over(w))
    cut = safe_cut(m, F.col("_old"))
    return m.groupBy("conv_id").agg(F.max("total").alias("total")).join(cut, "conv_id")


def gap_repair(messages: DataFrame, text: str = "canceled") -> DataFrame:
    """messages (conv_id, turn, role, text, calls array<string>) with a made-up tool result for every call of a message
    that is followed by one that is no tool result; place orders all. A call at the very end stays as it is."""
    ahead = messages.withColumn("_next", F.lead("role").over(_ordered()))
    real = messages.select("conv_id", "turn", F.lit(0).alias("place"), "role", "text", F.lit(None).cast("string").alias("call_id"))
    broken = ahead.where((F.size("calls") > 0) & F.col("_next").isNotNull() & (F.col("_next") != "tool"))
    made = broken.select("conv_id", "turn", F.posexplode("calls").alias("_p", "call_id")).select(
        "conv_id", "turn", (F.col("_p") + 1).alias("place"), F.lit("tool").alias("role"), F.lit(text).alias("text"), "call_id"
    )
    return real.unionByName(made)


def cancel_unanswered(messages: DataFrame, text: str = "canceled") -> DataFrame:
    """The same for every call that no tool result (call_id) of the conversation answers, wherever it stands."""
    calls = messages.select("conv_id", "turn", F.posexplode("calls").alias("_p", "call_id"))
    answered = messages.where("role = 'tool'").select("conv_id", "call_id")
    made = calls.join(answered, ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "turn", (F.col("_p") + 1).alias("place"), F.lit("tool").alias("role"), F.lit(text).alias("text"), "call_id"
    )
    return messages.select("conv_id", "turn", F.lit(0).alias("place"), "role", "text", "call_id").unionByName(made)


def fill_empty(role: Column, text: Column) -> Column:
    """Empty texts become one blank, but for system and tool messages."""
    return F.when(role.isin("system", "tool"), text).otherwise(F.when(F.coalesce(text, F.lit("")) == "", F.lit(" ")).otherwise(text))


def resend(messages: DataFrame, ids: Column) -> DataFrame:
    """Messages that stay when those that ``ids`` (a predicate) names are sent again: what follows the first of them goes,
    but for themselves."""
    before = _ordered().rowsBetween(W.unboundedPreceding, -1)
    after = F.coalesce(F.max(ids.cast("int")).over(before) == 1, F.lit(False))
    return messages.withColumn("_a", after).withColumn("_i", ids).where("_i or not _a").drop("_a", "_i")


def current_turn(messages: DataFrame, role: str = "user") -> DataFrame:
    """The last message of a role and all that follow it."""
    last = F.max(F.when(F.col("role") == role, F.col("turn"))).over(W.partitionBy("conv_id"))
    return messages.withColumn("_l", last).where("turn >= _l").drop("_l")


def removed(before: DataFrame, kept: DataFrame, *keys: str) -> DataFrame:
    return before.join(kept.select(*keys), list(keys), "left_anti")


def truncated(text: Column, limit: int = TOOL_RESULT_CAP) -> Column:
    """A long tool result cut to ``limit`` characters, with a note of its size."""
    note = F.concat(
        F.lit("\n\n... [TRUNCATED: "), F.format_number(F.length(text), 0), F.lit(f" chars total, showing first {limit:,}. Use specific tool calls to get details on individual items.]")
    )
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def summary_input(messages: DataFrame) -> DataFrame:
    """(conv_id, conversation): the messages as text for a summary, each cut to what its role is allowed."""
    cap = lambda role: shortened(F.col("text"), SUMMARY_CAPS[role])
    line = (
        F.when(F.col("role") == "system", F.concat(F.lit("[System: "), cap("system"), F.lit("]")))
        .when(F.col("role") == "user", F.concat(F.lit("User: "), cap("user")))
        .when((F.col("role") == "assistant") & (F.trim("text") != ""), F.concat(F.lit("Assistant: "), cap("assistant")))
        .when(F.col("role") == "tool", F.concat(F.lit("Tool result: "), cap("tool")))
    )
    lines = messages.withColumn("_line", line).where("_line is not null")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "_line")))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), "\n\n").alias("conversation"))


def context_window(model: Column, configured: Column | None = None) -> Column:
    """Input tokens of a model: a configured value, an exact name, a mark like [200k], a family, a default."""
    mark = F.regexp_extract(model, r"\[(\d+)\s*[kKmM]\]", 1)
    unit = F.lower(F.regexp_extract(model, r"\[\d+\s*([kKmM])\]", 1))
    exact = F.create_map(*[F.lit(x) for pair in CONTEXT_WINDOWS.items() for x in pair])[model]
    family = F.lit(CONTEXT_DEFAULT)
    for part, size in reversed(CONTEXT_FAMILIES):
        family = F.when(F.contains(F.lower(model), F.lit(part)), F.lit(size)).otherwise(family)
    marked = F.when(mark != "", F.expr("1") * mark.try_cast("long") * F.when(unit == "k", 1_000).otherwise(1_000_000))
    own = F.when(configured > 0, configured) if configured is not None else F.lit(None)
    return F.coalesce(own.cast("long"), exact.cast("long"), marked, family.cast("long"))

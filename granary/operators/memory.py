"""Conversation memory: windows, compression plans and summary inputs, by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import contains_any, strip

#: Fixed marker texts and sizes of the rules.
FAILURES = ["[error]", "Answer generation failed", "Request timed out", "无法回答", "知识库内容不相关", "完全不相关", "缺少相关信息", "没有任何关于"]
LOW_VALUE = [*FAILURES, "没有任何"]
EXPLICIT = ["记住", "请记住", "帮我记住", "remember"]
DURABLE = ["我的目标", "我的偏好", "我喜欢", "我不喜欢", "我习惯", "我希望", "我正在", "我当前", "以后", "以后都", "下次", "下次请", "我的项目", "项目是", "系统是", "架构是", "技术栈", "当前记忆系统"]
SKIPPED = ["message_count_not_exceed_trigger", "no_evicted_messages", "no_new_messages_after_summary_boundary"]
TRIGGER_TOKENS, CHARS_A_TOKEN = 3000, 4
RECENT, TRIGGER, MESSAGE_CHARS, INPUT_CHARS, MEMORY_CHARS = 6, 12, 1200, 6000, 2000


def by_session():
    return Window.partitionBy("session_id")


def body() -> Column:
    return strip(F.coalesce("content", F.lit("")))


def is_low_value() -> Column:
    """Blank, not completed, or an assistant's failure."""
    return (body() == "") | (F.coalesce("status", F.lit("completed")) != "completed") | ((F.col("role") == "assistant") & contains_any(body(), LOW_VALUE))


def low_value_messages(messages: DataFrame) -> DataFrame:
    return messages.withColumn("low_value", is_low_value())


def recent_messages(messages: DataFrame, n: int = RECENT) -> DataFrame:
    """Each session's last n messages that are not blank, in ascending order (position from 1)."""
    last = messages.withColumn("back", F.row_number().over(by_session().orderBy(F.desc("message_id")))).where(F.col("back") <= n)
    last = last.where(body() != "")
    return last.withColumn("position", F.row_number().over(by_session().orderBy("message_id"))).drop("back")


def compression_plan(messages: DataFrame, summaries: DataFrame, recent: int = RECENT, trigger: int = TRIGGER) -> DataFrame:
    """One row a session: counts, ids of evicted messages that the summary doesn't cover, whether to compress, and why
    not; beside it, whether the buffer's estimated tokens (a quarter of its characters) reach the other trigger."""
    back = messages.withColumn("back", F.row_number().over(by_session().orderBy(F.desc("message_id"))))
    rows = back.join(summaries.select("session_id", "covered_until_message_id", "covered_message_count"), "session_id", "left")
    evicted = F.col("back") > recent
    new = evicted & (F.col("covered_until_message_id").isNull() | (F.col("message_id") > F.col("covered_until_message_id")))
    got = rows.groupBy("session_id").agg(
        F.count("*").alias("message_count"),
        F.sum(F.when(evicted, 0).otherwise(1)).alias("recent_message_count"),
        F.sum(F.when(evicted, 1).otherwise(0)).alias("evicted_message_count"),
        F.sum(F.when(new, 1).otherwise(0)).alias("new_message_count"),
        F.first("covered_until_message_id").alias("covered_until_message_id"),
        F.array_sort(F.collect_list(F.when(new, F.col("message_id")))).alias("new_message_ids"),
        F.first("covered_message_count").alias("covered_before"),
        F.floor(F.sum(F.length(F.coalesce("content", F.lit("")))) / CHARS_A_TOKEN).alias("estimated_tokens"),
    )
    why = F.when(F.col("message_count") <= trigger, SKIPPED[0]).when(F.col("evicted_message_count") <= 0, SKIPPED[1]).when(F.col("new_message_count") <= 0, SKIPPED[2]).otherwise("")
    got = got.withColumn("skip_reason", why).withColumn("token_trigger", F.col("estimated_tokens") >= TRIGGER_TOKENS)
    return got.withColumn("should_compress", (F.col("message_count") > trigger) & (F.col("new_message_count") > 0)).withColumn("next_covered_count", F.coalesce("covered_before", F.lit(0)) + F.col("new_message_count")).drop("covered_before")


def new_messages(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """The messages that a session's compression would take up."""
    ids = plan.where("should_compress").select("session_id", F.explode("new_message_ids").alias("message_id"))
    return messages.join(ids, ["session_id", "message_id"])


def summary_input(messages: DataFrame, message_chars: int = MESSAGE_CHARS, most_chars: int = INPUT_CHARS) -> DataFrame:
    """(session_id, summary_input): 'role: text' lines of worthwhile messages, each clipped, within the budget."""
    rows = messages.where(~is_low_value()).select("session_id", "message_id", F.concat("role", F.lit(": "), F.substring(body(), 1, message_chars)).alias("line"))
    before = F.coalesce(F.sum(F.length("line")).over(by_session().orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", before).where(F.col("used") < most_chars)
    line = F.substr("line", F.lit(1), (F.lit(most_chars) - F.col("used")).cast("int"))
    rows = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("message_id", line.alias("line")))).alias("rows"))
    return rows.select("session_id", F.array_join(F.transform("rows", lambda x: x["line"]), "\n").alias("summary_input"))


def fallback_summary(messages: DataFrame, summaries: DataFrame, most_lines: int = 5, clip_chars: int = 120, most_chars: int = 500) -> DataFrame:
    """(session_id, summary): the previous summary, then the first user and assistant messages up to five lines."""
    said = F.when(F.col("role") == "user", F.concat(F.lit("用户曾提到："), F.substring(body(), 1, clip_chars))).when(F.col("role") == "assistant", F.concat(F.lit("助手曾确认："), F.substring(body(), 1, clip_chars)))
    rows = messages.where(~is_low_value() & F.col("role").isin("user", "assistant")).select("session_id", "message_id", said.alias("line"))
    rows = rows.withColumn("nth", F.row_number().over(by_session().orderBy("message_id"))).where(F.col("nth") <= most_lines)
    rows = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", "line"))).alias("rows"))
    joined = rows.join(summaries.select("session_id", strip(F.coalesce("summary", F.lit(""))).alias("previous")), "session_id", "left")
    lines = F.transform("rows", lambda x: x["line"])
    had = F.coalesce(F.col("previous") != "", F.lit(False))
    # the line that fills the list is still added, so a previous summary leaves room for one line less, never none
    all_lines = F.when(had, F.concat(F.array("previous"), F.slice(lines, 1, most_lines - 1))).otherwise(lines)
    return joined.select("session_id", F.substring(F.array_join(all_lines, "；"), 1, most_chars).alias("summary"))


def long_term_memory_gate(messages: DataFrame, most_chars: int = MEMORY_CHARS) -> DataFrame:
    """(session_id, message_id, memory): user messages with a lasting marker whose next message is a sound answer;
    clipped, and of equal texts of a session the first."""
    turns = messages.where(F.col("role").isin("user", "assistant", "system"))
    following = lambda c: F.lead(c).over(by_session().orderBy("message_id"))
    rows = turns.withColumn("next_role", following("role")).withColumn("answer", strip(F.coalesce(following("content"), F.lit("")))).withColumn("memory", body())
    keep = (F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("memory") != "") & (F.col("answer") != "")
    rows = rows.where(keep & contains_any(F.col("memory"), EXPLICIT + DURABLE) & ~contains_any(F.col("answer"), FAILURES))
    rows = rows.select("session_id", "message_id", F.substring("memory", 1, most_chars).alias("memory"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("session_id", "memory").orderBy("message_id"))).where("nth = 1").drop("nth")


def prompt_memory_context(messages: DataFrame, summaries: DataFrame, memories: DataFrame, most_messages: int = 8) -> DataFrame:
    """(session_id, context): long-term memories (5), the summary and the last messages as one text block."""
    kept = memories.withColumn("nth", F.row_number().over(by_session().orderBy("message_id"))).where("nth <= 5").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("nth", "memory"))).alias("m"))
    m_lines = F.transform("m", lambda x: F.concat(F.lit("- "), F.substring(x["memory"], 1, 500)))
    last = recent_messages(messages, most_messages).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("role", F.lit(": "), F.substring(body(), 1, 500)).alias("line")))).alias("r"))
    r_lines = F.transform("r", lambda x: x["line"])
    rows = last.join(summaries.select("session_id", F.coalesce("summary", F.lit("")).alias("s")), "session_id", "left").join(kept, "session_id", "left")
    part = lambda head, lines: F.concat(F.array(F.lit(head)), lines, F.array(F.lit("")))
    none = F.array().cast("array<string>")
    text = F.concat(F.when(F.col("m").isNotNull(), part("【长期记忆】", m_lines)).otherwise(none), F.when(F.col("s") != "", part("【历史摘要】", F.array(F.substring("s", 1, 1200)))).otherwise(none), part("【最近对话】", r_lines))
    return rows.select("session_id", F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("context"))


def latest_sessions(sessions: DataFrame, n: int = 50) -> DataFrame:
    """Each owner's active sessions, last message first (those without one last), then newest."""
    order = Window.partitionBy("owner_id").orderBy(F.desc_nulls_last("last_message_at"), F.desc("created_at"), "session_id")
    return sessions.where("is_active").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)

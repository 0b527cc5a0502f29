"""Queries of conversation memory over sessions of five conversations each, and of event roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import memory as M
from granary.plans.registry import INPUTS, query

INPUTS["messages"] = """
select cast(floor(conv_id / 5) as bigint) as session_id, conv_id * 100 + turn as message_id, role,
  case when (conv_id + turn) % 6 = 0 then '请记住 ' || text when (conv_id + turn) % 13 = 0 then '无法回答 ' || text when (conv_id + turn) % 17 = 0 then ' ' else text end as content,
  case when (conv_id + turn) % 11 = 0 then 'error' else 'completed' end as status
from conversations
"""
INPUTS["summaries"] = "select session_id, 'Earlier talk of session ' || cast(session_id as string) as summary, min(message_id) + 101 as covered_until_message_id, cast(3 as bigint) as covered_message_count from messages where session_id % 3 = 0 group by session_id"

BODY = r"regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')"
LOW = "(" + " or ".join([f"{BODY} = ''", "status <> 'completed'", "(role = 'assistant' and (" + " or ".join(f"contains({BODY}, '{w}')" for w in M.LOW_VALUE) + "))"]) + ")"
FAILED = "(" + " or ".join(f"contains(answer, '{w}')" for w in M.FAILURES) + ")"
LASTING = "(" + " or ".join(f"contains(memory, '{w}')" for w in M.EXPLICIT + M.DURABLE) + ")"


@query("low_value_messages", f"select session_id, message_id, {LOW} as low_value from messages")
def low_value_messages(t):
    return M.low_value_messages(t.messages).select("session_id", "message_id", "low_value")


RECENT = f"recent as (select *, row_number() over (partition by session_id order by message_id) as position from (select *, row_number() over (partition by session_id order by message_id desc) as back from messages) where back <= {{n}} and {BODY} <> '')"


@query("recent_messages", f"with {RECENT.format(n=6)} select session_id, message_id, position from recent")
def recent_messages(t):
    return M.recent_messages(t.messages).select("session_id", "message_id", "position")


PLAN = """b as (select m.*, row_number() over (partition by session_id order by message_id desc) as back, covered_until_message_id, covered_message_count from messages m left join summaries using (session_id)),
plan as (select session_id, count(*) as message_count, count(case when back <= 6 then 1 end) as recent_message_count, count(case when back > 6 then 1 end) as evicted_message_count,
  count(case when back > 6 and (covered_until_message_id is null or message_id > covered_until_message_id) then 1 end) as new_message_count, max(covered_until_message_id) as covered_until_message_id,
  coalesce(string_agg(case when back > 6 and (covered_until_message_id is null or message_id > covered_until_message_id) then cast(message_id as string) end, ',' order by message_id), '') as new_message_ids, coalesce(max(covered_message_count), 0) as covered_before, cast(floor(sum(length(coalesce(content, ''))) / 4) as bigint) as estimated_tokens from b group by 1)"""


@query("compression_plan", f"with {PLAN} select session_id, message_count, recent_message_count, evicted_message_count, new_message_count, covered_until_message_id, new_message_ids, message_count > 12 and new_message_count > 0 as should_compress, covered_before + new_message_count as next_covered_count, estimated_tokens, estimated_tokens >= 3000 as token_trigger, case when message_count <= 12 then 'message_count_not_exceed_trigger' when evicted_message_count <= 0 then 'no_evicted_messages' when new_message_count <= 0 then 'no_new_messages_after_summary_boundary' else '' end as skip_reason from plan")
def compression_plan(t):
    return M.compression_plan(t.messages, t.summaries).withColumn("new_message_ids", F.array_join(F.transform("new_message_ids", lambda x: x.cast("string")), ","))


LINES = f"l as (select session_id, message_id, role || ': ' || substr({BODY}, 1, 1200) as line from messages where not {LOW})"


@query(
    "summary_input",
    f"""with {LINES}, u as (select *, coalesce(sum(length(line)) over (partition by session_id order by message_id rows between unbounded preceding and 1 preceding), 0) as used from l)
select session_id, md5(string_agg(substr(line, 1, cast(6000 - used as bigint)), chr(10) order by message_id)) as input_md5 from u where used < 6000 group by 1""",
)
def summary_input(t):
    return M.summary_input(t.messages).select("session_id", F.md5("summary_input").alias("input_md5"))


@query(
    "fallback_summary",
    f"""with l as (select session_id, message_id, case role when 'user' then '用户曾提到：' else '助手曾确认：' end || substr({BODY}, 1, 120) as line from messages where not {LOW} and role in ('user', 'assistant')),
n as (select *, row_number() over (partition by session_id order by message_id) as nth from l),
j as (select session_id, max(summary) as previous, string_agg(case when nth <= case when summary is null then 5 else 4 end then line end, '；' order by nth) as rest from n left join summaries using (session_id) group by 1)
select session_id, substr(case when previous is null then rest else previous || '；' || rest end, 1, 500) as summary from j""",
)
def fallback_summary(t):
    return M.fallback_summary(t.messages, t.summaries)


GATE = f"""turns as (select *, lead(role) over w as next_role, regexp_replace(coalesce(lead(content) over w, ''), '^\\s+|\\s+$', '', 'g') as answer, {BODY} as memory from messages where role in ('user', 'assistant', 'system') window w as (partition by session_id order by message_id)),
gated as (select session_id, message_id, substr(memory, 1, 2000) as memory from turns where role = 'user' and next_role = 'assistant' and memory <> '' and answer <> '' and {LASTING} and not {FAILED}),
kept as (select * from (select *, row_number() over (partition by session_id, memory order by message_id) as nth from gated) where nth = 1)"""


@query("long_term_memory_gate", f"with {GATE} select session_id, message_id, md5(memory) as memory_md5 from kept")
def long_term_memory_gate(t):
    return M.long_term_memory_gate(t.messages).select("session_id", "message_id", F.md5("memory").alias("memory_md5"))


@query(
    "prompt_memory_context",
    f"""with {RECENT.format(n=8)}, {GATE},
r as (select session_id, string_agg(role || ': ' || substr({BODY}, 1, 500), chr(10) order by position) as lines from recent group by 1),
k as (select session_id, string_agg('- ' || substr(memory, 1, 500), chr(10) order by message_id) as lines from (select *, row_number() over (partition by session_id order by message_id) as place from kept) where place <= 5 group by 1)
select r.session_id, md5(case when k.lines is not null then '【长期记忆】' || chr(10) || k.lines || chr(10) || chr(10) else '' end || case when summary is not null then '【历史摘要】' || chr(10) || substr(summary, 1, 1200) || chr(10) || chr(10) else '' end
  || '【最近对话】' || chr(10) || r.lines || chr(10) || chr(10)) as context_md5 from r left join summaries using (session_id) left join k on k.session_id = r.session_id""",
)
def prompt_memory_context(t):
    got = M.prompt_memory_context(t.messages, t.summaries, M.long_term_memory_gate(t.messages))
    return got.select("session_id", F.md5("context").alias("context_md5"))


SESSIONS = "select floor(session_id / 4) as owner_id, session_id, max(message_id) % 1000 as last_message_at, min(message_id) as created_at, session_id % 5 <> 0 as is_active from messages group by session_id"
INPUTS["sessions"] = SESSIONS


@query("latest_sessions", "select * from (select cast(owner_id as bigint) as owner_id, session_id, row_number() over (partition by owner_id order by last_message_at desc nulls last, created_at desc, session_id) as place from sessions where is_active) where place <= 50")
def latest_sessions(t):
    return M.latest_sessions(t.sessions).select(F.col("owner_id").cast("long").alias("owner_id"), "session_id", "place")

"""Queries of golden questions, their refinement and prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.tables import written
from granary.operators import fusion, goldens
from granary.operators import questions as Q
from granary.plans.registry import INPUTS, query
from granary.plans.retrieval import PACKED

#: Customers as companies: an annual and a quarterly report each, with metrics from their balances, some missing.
COMPANY = "'T' || lpad(cast(c_custkey as string), 9, '0') as ticker, c_name as company, 'T' || lpad(cast(c_custkey as string), 9, '0') || '/{0}.pdf' as rel_path, cast(c_custkey % 30 + 1 as int) as page, case when c_custkey % 3 = 0 then '千元' else '元' end as unit, repeat(c_name || '   page' || chr(10) || chr(10) || chr(10) || 'x ', 40) as page_text"
AMOUNT = "cast(cast(c_acctbal * {0} as decimal(18, 2)) as string)"
METRIC_LIST = "(select 'revenue' as metric, 1 as k union all select 'net_profit', 2 union all select 'cashflow', 3 union all select 'total_assets', 4 union all select 'eps', 5 union all select 'other', 6) m"
INPUTS["annual_rows"] = f"select {COMPANY.format('annual')}, metric, case when (c_custkey + k) % 7 = 0 then null else {AMOUNT.format('k')} end as v0, case when (c_custkey + k) % 5 = 0 then null else {AMOUNT.format('(k + 10)')} end as v1, case when (c_custkey + k) % 4 = 0 then ' ' else cast(k as string) || '%' end as v2, case when c_custkey % 2 = 0 then '' else metric || '   line  ' || c_name end as snippet from customer cross join {METRIC_LIST}"
INPUTS["quarter_rows"] = f"select {COMPANY.format('q1')}, metric, case when (c_custkey + k) % 3 = 0 then null else {AMOUNT.format('(k + 20)')} end as v0, 'quarter ' || metric as snippet from customer cross join {METRIC_LIST} where c_custkey % 4 <> 1"
INPUTS["profile_rows"] = f"select {COMPANY.format('annual')}, field, case when (c_custkey + k) % 6 = 0 then ' ' else field || ' of ' || c_name end as value from customer cross join (select 'legal_rep' as field, 1 as k union all select 'website', 2 union all select 'registered_address', 3 union all select 'stock_code', 4) f"


def records_of(t):
    annual = t.annual_rows.withColumn("values", F.when(F.col("v0").isNotNull(), F.array("v0", "v1", "v2")))
    quarterly = t.quarter_rows.withColumn("values", F.when(F.col("v0").isNotNull(), F.array("v0")))
    return Q.golden_questions(annual, quarterly, t.profile_rows)


def squeezed(text, most):
    clean = f"regexp_replace(regexp_replace(regexp_replace({text}, '[ \\t\\r\\f\\v]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"regexp_replace(substr({clean}, 1, {most}), '^\\s+|\\s+$', '', 'g')"


def named(table, key):
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def sql_text(template, **values):
    """The template as SQL: the same placeholders, other engine."""
    for name, sql in values.items():
        template = template.replace("{" + name + "}", f"' || {sql} || '")
    return f"'{template}'"


SHOWN = {"company": "company", "label": "label", "value": "v0", "unit": "unit"}
METRIC_NO = "case metric when 'revenue' then 1 when 'net_profit' then 2 when 'cashflow' then 3 when 'total_assets' then 4 when 'eps' then 5 end"
SNIPPET = squeezed("coalesce(nullif(snippet, ''), page_text)", 700)
PAGE = squeezed("page_text", 750)
SPAN = "rel_path || '#page=' || cast(page as string) || '#span={0}'"


def kind(number, pos, question, answer, source, difficulty, question_type, files, pages, text, ids, eval_type="exact_or_semantic", subject="null", right="null"):
    return f"select {number} as kind, ticker, {pos} as pos, {question} as question, {answer} as answer, company, {difficulty} as difficulty, '{question_type}' as question_type, '{eval_type}' as eval_type, {files} as gold_files, {pages} as gold_pages, {text} as gold_evidence, {ids} as evidence_ids, {subject} as subject, {right} as right_company from {source}"


ONE = ("rel_path", "cast(page as string)")
PROFILES = " when ".join(f"'{k}' then {sql_text(q, company='company', value='value')}" for k, (q, _) in Q.PROFILE.items())
ANSWERS = " when ".join(f"'{k}' then {sql_text(a, company='company', value='value')}" for k, (_, a) in Q.PROFILE.items())
HIGHER = lambda name: sql_text(Q.HIGHER, unit="unit", name=name)
PAIR = {**SHOWN, "other": "o_company", "o_value": "o_v0", "o_unit": "o_unit"}
KINDS = [
    kind(1, "case field when 'legal_rep' then 1 when 'website' then 2 when 'registered_address' then 3 else 4 end", f"case field when {PROFILES} end", f"case field when {ANSWERS} end", "(select * from profile_rows where trim(value) <> '')", "'simple'", "company_profile", *ONE, PAGE, SPAN.format("company_profile"), subject="field"),
    kind(2, METRIC_NO, sql_text(Q.ANNUAL[0], **SHOWN), sql_text(Q.ANNUAL[1], **SHOWN), "(select * from a where metric <> 'other')", "case when metric in ('revenue', 'net_profit') then 'simple' else 'medium' end", "table_numeric", *ONE, SNIPPET, SPAN.format("annual_' || metric || '"), subject="metric"),
    kind(3, METRIC_NO, sql_text(Q.QUARTER[0], **SHOWN), sql_text(Q.QUARTER[1], **SHOWN), "(select * from q where metric in ('revenue', 'net_profit'))", "'medium'", "quarterly_table_numeric", *ONE, SNIPPET, SPAN.format("q1_' || metric || '"), subject="metric"),
    kind(4, METRIC_NO, sql_text(Q.YEARS[0], **SHOWN), f"{sql_text(Q.YEARS[1], before='v1', **SHOWN)} || case when trim(v2) <> '' then {sql_text(Q.CHANGE, change='v2')} else '' end", "(select * from a where metric in ('revenue', 'net_profit') and v1 is not null)", "'complex'", "cross_year_compare", *ONE, SNIPPET, SPAN.format("annual_' || metric || '"), subject="metric"),
    kind(5, "0", sql_text(Q.TWO_REPORTS[0], company="company"), sql_text(Q.TWO_REPORTS[1], **SHOWN, q_value="q_v0", q_unit="unit"), "twice", "'multi_hop'", "cross_doc_multi_hop", "rel_path || ',' || q_path", "cast(page as string) || ',' || cast(page as string)", f"{SNIPPET} || chr(10) || chr(10) || q_text", SPAN.format("annual_revenue") + " || ',' || q_id", subject="metric"),
    kind(6, "nth", sql_text(Q.TWO_COMPANIES[0], **PAIR), f"{sql_text(Q.TWO_COMPANIES[1], **PAIR)} || case when unit <> o_unit then '{Q.NOT_COMPARABLE}' when cast(v0 as decimal(38, 2)) > cast(o_v0 as decimal(38, 2)) then {HIGHER('company')} when cast(v0 as decimal(38, 2)) < cast(o_v0 as decimal(38, 2)) then {HIGHER('o_company')} else {sql_text(Q.EQUAL, unit='unit')} end", "pairs", "'multi_hop'", "cross_company_compare", "rel_path || ',' || o_path", "cast(page as string) || ',' || cast(o_page as string)", f"{SNIPPET} || chr(10) || chr(10) || o_text", SPAN.format("annual_revenue") + " || ',' || o_id", right="o_company", subject="metric"),
    kind(7, "0", sql_text(Q.NOT_DISCLOSED[0], company="company"), sql_text(Q.NOT_DISCLOSED[1], company="company"), "(select distinct ticker, company, rel_path, page, page_text from a order by ticker limit 12)", "'negative'", "unanswerable", *ONE, PAGE, SPAN.format("annual_main_metrics"), "abstention"),
    kind(8, METRIC_NO, sql_text(Q.ONLY_FROM, **SHOWN), sql_text(Q.ANNUAL[1], **SHOWN), "(select * from a where metric in ('revenue', 'net_profit', 'cashflow', 'total_assets'))", "'medium'", "hard_negative_table_numeric", *ONE, SNIPPET, SPAN.format("annual_' || metric || '"), subject="metric"),
]
GOLDEN = f"""a as (select *, {named(Q.METRICS, 'metric')} as label from annual_rows where v0 is not null), q as (select *, {named(Q.METRICS, 'metric')} as label from quarter_rows where v0 is not null),
seen as (select *, {SNIPPET} as short, {SPAN.format("annual_revenue")} as span from a where metric = 'revenue'),
twice as (select a.*, q.v0 as q_v0, q.rel_path as q_path, q.snippet as q_text, q.rel_path || '#page=' || cast(q.page as string) || '#span=q1_revenue' as q_id from a join q using (ticker) where a.metric = 'revenue' and q.metric = 'revenue'),
pairs as (select *, row_number() over (order by ticker, o_ticker) as nth from (select x.*, y.ticker as o_ticker, y.company as o_company, y.v0 as o_v0, y.unit as o_unit, y.rel_path as o_path, y.page as o_page, y.short as o_text, y.span as o_id from (select * from seen order by ticker limit 23) x join (select * from seen order by ticker limit 23) y on x.ticker < y.ticker order by x.ticker, y.ticker limit 22)),
records as (select *, row_number() over (order by kind, ticker, pos) as place from ({" union all ".join(KINDS)})),
golden as (select *, case when place < 1000 then printf('v2_%03d', place) else 'v2_' || cast(place as string) end as id from records)"""


@query("golden_questions", f"with {GOLDEN} select id, question, answer, company, ticker as stock_code, difficulty, question_type, eval_type, gold_files, gold_pages, md5(gold_evidence) as evidence_md5, evidence_ids from golden")
def golden_questions(t):
    got = records_of(t)
    ids = F.array_join(F.transform("positive_contexts", lambda c: c["evidence_id"]), ",").alias("evidence_ids")
    return got.select("id", "question", "answer", "company", "stock_code", "difficulty", "question_type", "eval_type", F.array_join("gold_files", ",").alias("gold_files"), F.array_join(F.transform("gold_pages", lambda p: p.cast("string")), ",").alias("gold_pages"), F.md5("gold_evidence").alias("evidence_md5"), ids)


REWORDED = {k: sql_text(v, company="company", metric=f"coalesce({named(Q.METRICS, 'subject')}, '相关指标')", field=named(Q.FIELDS, "subject"), left="company", right="right_company") for k, v in Q.REFINED.items()}


@query("refine_questions", f"with {GOLDEN} select case when n < 1000 then printf('v3_%03d', n) else 'v3_' || cast(n as string) end as id, source_eval_id, question from (select row_number() over (order by id) as n, id as source_eval_id, case question_type {' '.join(f'when {chr(39)}{k}{chr(39)} then {v}' for k, v in REWORDED.items())} end as question from golden)")
def refine_questions(t):
    records = written(records_of(t), "golden")
    return Q.refine_questions(records, t.annual_rows.select("ticker", "company")).select("id", "source_eval_id", "question")


INPUTS["interim"] = "select query_id, rank as number, case when rank % 3 = 0 then ' ' else 'sub ' || chunk_id end as question, case when rank % 3 = 0 then '' else ' answer ' || doc_id end as answer from hits where rank <= 4"
INPUTS["remembered"] = "select query_id, '【历史摘要】' || chr(10) || query_id || chr(10) || chr(10) as context from asks where length(query_id) % 2 = 0"


@query(
    "build_prompts",
    f"""with {PACKED}, n as (select u.query_id, string_agg('[来源 ' || cast(snippet_no as string) || '] 文档=' || split_part(h.source_path, '/', 2) || '；页码=' || h.page_range || '；chunk=' || u.chunk_id || chr(10) || substr(u.text, 1, cast(4000 - used as bigint)), chr(10) || chr(10) order by snippet_no) as evidence
  from u join hits h on h.query_id = u.query_id and h.chunk_id = u.chunk_id where used < 4000 group by 1),
i as (select query_id, '【子问题中间答案】' || chr(10) || string_agg(cast(number as string) || '. 子问题：' || question || chr(10) || '   中间答案：' || trim(answer), chr(10) order by number) || chr(10) || chr(10) as said from interim where trim(question) <> '' group by 1)
select query_id, md5('{Q.OPENING}' || coalesce(context, '') || coalesce(said, '') || '{Q.CONTEXT_HEAD}' || coalesce(evidence, '{Q.NO_CONTEXT}') || '{Q.DEMANDS}' || 'what about ' || query_id) as prompt_md5
from asks left join n using (query_id) left join i using (query_id) left join remembered using (query_id)""",
)
def build_prompts(t):
    label = goldens.source_label(fusion.base_of(F.col("source_path")), F.col("source_path"), F.col("page_range"), F.lit(""), F.col("chunk_id"))
    packed = fusion.pack_context(t.hits).join(t.hits.select("query_id", "chunk_id", label.alias("label")), ["query_id", "chunk_id"])
    asked = t.asks.withColumn("question", F.concat(F.lit("what about "), "query_id"))
    return Q.build_prompts(asked, packed, t.remembered, t.interim).select("query_id", F.md5("prompt").alias("prompt_md5"))

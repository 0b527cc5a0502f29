"""Queries of column functions, metadata contracts, golden questions and file indexes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary.functions import queries as Q
from granary.functions import text as T
from granary.operators import fusion, goldens
from granary.plans.registry import INPUTS, query


@query("normalize_spaces", r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace('  ' || text || chr(9) || chr(10), chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as text_md5 from documents")
def normalize_spaces(t):
    odd = F.concat(F.lit("  ​"), F.col("text"), F.lit("\t\n"))
    return t.documents.select("doc_id", F.md5(T.normalize_spaces(F.replace(odd, F.lit("\n"), F.lit("\n\n\n\n")))).alias("text_md5"))


@query("page_ranges", "select doc_id, array_to_string(list_sort(list_distinct(list_concat(range(least(doc_id % 7 + 1, doc_id % 5 + 2), greatest(doc_id % 7 + 1, doc_id % 5 + 2) + 1), [doc_id % 20 + 3]))), ',') as pages, cast(least(doc_id % 7 + 1, doc_id % 5 + 2, doc_id % 20 + 3) as string) || case when least(doc_id % 7 + 1, doc_id % 5 + 2, doc_id % 20 + 3) = greatest(doc_id % 7 + 1, doc_id % 5 + 2, doc_id % 20 + 3) then '' else '-' || cast(greatest(doc_id % 7 + 1, doc_id % 5 + 2, doc_id % 20 + 3) as string) end as page_range from documents")
def page_ranges(t):
    pages = T.page_numbers(F.expr("cast(doc_id % 7 + 1 as string) || '–' || cast(doc_id % 5 + 2 as string) || '; p. x，' || cast(doc_id % 20 + 3 as string)"))
    return t.documents.select("doc_id", pages.alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"), T.page_range(F.col("p")).alias("page_range"))


INPUTS["raw_paths"] = "select doc_id, case doc_id % 4 when 0 then ' docs/' when 1 then '//' when 2 then 'docs/docs/' else '' end || replace(source, 'c', '//') || '/' || split_part(text, ' ', 1) || '/' || cast(doc_id as string) || '.txt//' as path from documents"


@query("normalize_path", r"with p as (select doc_id, regexp_replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), '/+', '/', 'g') as path from raw_paths) select doc_id, regexp_replace(case when starts_with(path, 'docs/') then substr(path, 6) else path end, '^/+|/+$', '', 'g') as path from p".replace("\\\\", "\\"))
def normalize_path(t):
    return t.raw_paths.select("doc_id", T.normalize_path(F.col("path")).alias("path"))


WORDS = r"regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')"


@query("markdown_table", f"with w as (select doc_id, {WORDS} as w from documents) select doc_id, lower(w[1]) || '|' || lower(w[2]) as header, 2 + case when len(w) >= 6 then 1 else 0 end as n_rows, case when len(w) >= 6 then 3 else 2 end as n_columns from w where len(w) >= 4")
def markdown_table(t):
    """The first words of each document as a table of two columns, with a third in its last row."""
    w = T.F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]+)"), F.lit(1))
    rows = t.documents.select("doc_id", w.alias("w")).where("size(w) >= 4")
    line = lambda *i: F.concat(F.lit("|  "), F.array_join(F.array(*(F.get("w", F.lit(k)) for k in i)), " | "), F.lit(" |"))
    text = F.concat_ws("\n", line(0, 1), F.lit("|:---|---:|"), line(2, 3), F.when(F.size("w") >= 6, line(3, 4, 5)), F.lit("no row"))
    cells = T.table_cells(text)
    return rows.select("doc_id", F.array_join(T.table_header(cells), "|").alias("header"), F.size(cells).alias("n_rows"), T.column_count(text).alias("n_columns"))


INPUTS["with_units"] = "select doc_id, n_chars, case doc_id % 7 when 0 then text || ' 单位：千元' when 1 then '（百万元）' || text when 2 then text || '(元)' || text when 3 then text || '人民币百万元（元）' when 4 then text || ' 百万元' when 5 then '（元）（千元）' || text else text end as body from documents"


@query(
    "detect_unit",
    "select doc_id, case when contains(body, '（千元）') or contains(body, '(千元)') or contains(body, '单位：千元') then '千元' when contains(body, '人民币百万元') or contains(body, '单位：百万元') or contains(body, '（百万元）') or contains(body, '(百万元)') then '百万元' when contains(body, '单位：元') or contains(body, '（元）') or contains(body, '(元)') then '元' else '以报告披露单位为准' end as unit, cast(n_chars as decimal(38,6)) / 2 as amount from with_units",
)
def detect_unit(t):
    return t.with_units.select("doc_id", T.detect_unit(F.col("body")).alias("unit"), T.to_decimal(F.concat(F.lit(" "), F.format_number(F.col("n_chars") / 2, 1))).alias("amount"))


@query("report_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as a, strftime(o_orderdate, '%Y-%m-%d') as b, 'Order_ ' || cast(o_orderkey as string) || '_' || o_orderpriority as title from orders")
def report_dates(t):
    seconds = F.unix_timestamp("o_orderdate")
    a = F.when(F.col("o_orderkey") % 2 == 0, seconds).otherwise(seconds * 1000).cast("string")
    title = T.safe_title(F.concat(F.lit("<b>Order:</b>  "), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", T.report_date(a).alias("a"), T.report_date(F.col("o_orderdate").cast("string")).alias("b"), title.alias("title"))


@query("source_label", "select chunk_id, '文档=' || split_part(source_path, '/', 2) || '；页码=' || page_range || '；chunk=' || chunk_id as label from chunks")
def source_label(t):
    return t.chunks.select("chunk_id", goldens.source_label(fusion.base_of(F.col("source_path")), F.col("source_path"), F.col("page_range"), F.lit(" "), F.col("chunk_id")).alias("label"))


@query("canonical_metadata", "select chunk_id, doc_id, source_path, split_part(source_path, '/', 2) as file_name, case when chunk_index % 5 = 0 then 'unknown' else chunk_role end as chunk_role, coalesce(parent_id, '') as parent_id from chunks")
def canonical_metadata(t):
    """Fields of chunks as loose maps of aliases."""
    m = F.create_map(F.lit("document_id"), F.col("doc_id"), F.lit("doc_id"), F.lit(" "), F.lit("file_path"), F.col("source_path"), F.lit("role"), F.when(F.col("chunk_index") % 5 == 0, "odd").otherwise(F.col("chunk_role")), F.lit("parent"), F.coalesce("parent_id", F.lit("")))
    return t.chunks.select("chunk_id", m.alias("m")).select("chunk_id", goldens.canonical_metadata(F.col("m")).alias("c")).select("chunk_id", "c.doc_id", "c.source_path", "c.file_name", "c.chunk_role", "c.parent_id")


@query(
    "source_payload",
    """select query_id, rank, md5(text) as text_md5, score, doc_id, split_part(source_path, '/', 2) as file_name, source_path, chunk_id, case when rank % 2 = 0 then 'parent_child' else chunk_role end as retrieval_mode, coalesce(parent_id, '') as parent_id,
  case when rank % 3 = 0 then 'up/' || chunk_id else source_path end as parent_source_path, case when rank % 3 = 0 then 'Up' else 'Own' end as parent_section_title, case when rank % 3 = 0 then '1-9' else page_range end as parent_page_range,
  case when rank % 4 = 0 then 'child' else chunk_id end as child_chunk_id, table_id, case when table_id <> '' then page_range else '' end as table_page_range, rank % 5 = 0 as auto_merged, case when rank % 5 = 0 then 0.5 end as merge_ratio, case when rank % 5 = 0 then rank end as merged_child_count, case when rank % 7 <> 0 then 4 end as total_child_count from hits""",
)
def source_payload(t):
    """Hits whose maps hold all fields, some of them, and numbers that are none."""
    n = F.col("rank")
    given = {
        **{k: F.col(k) for k in ("doc_id", "source_path", "chunk_id", "chunk_role", "parent_id", "page_range", "table_id")},
        "section_title": F.lit(" Own "), "retrieval_mode": F.when(n % 2 == 0, "parent_child"), "parent_source_path": F.when(n % 3 == 0, F.concat(F.lit("up/"), "chunk_id")), "parent_section_title": F.when(n % 3 == 0, "Up").otherwise(" "), "parent_page_range": F.when(n % 3 == 0, "1-9"),
        "child_chunk_id": F.when(n % 4 == 0, "child"), "table_page_range": F.when(F.col("table_id") != "", F.col("page_range")), "auto_merged": F.when(n % 5 == 0, "True").otherwise("0"), "merge_ratio": F.when(n % 5 == 0, "0.5").otherwise("none"), "merged_child_count": F.when(n % 5 == 0, n.cast("string")), "total_child_count": F.when(n % 7 != 0, " 4 ").otherwise("4 of 5"),
    }
    m = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v.cast("string"))))
    return t.hits.select("query_id", "rank", goldens.source_payload(m, F.col("text"), F.col("score")).alias("p")).select("query_id", "rank", "p.*").withColumn("text_md5", F.md5("text")).drop("text")


#: Questions of the router's kinds: whole messages behind phrases that each rule looks for.
INPUTS["routed"] = """select conv_id, turn, case (conv_id + turn) % 9 when 0 then '  ' when 1 then '你好！' when 2 then '请记住 ' || text when 3 then '统计用户数量 ' || text when 4 then '今天的新闻 ' || text when 5 then '请分析 ' || text
  when 6 then '我刚才说了什么' when 7 then '文档中统计用户数量 ' || text else text end as q from conversations"""


def sql_has(words):
    return f"regexp_matches(q, '(?i){'|'.join(map(re.escape, words))}')"


def sql_like(patterns):
    return "(" + " or ".join(f"regexp_matches(q, '{p}')" for p in patterns) + ")"


def sql_in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


ROUTED = rf"""s as (select conv_id, turn, regexp_replace(q, '^\s+|\s+$', '', 'g') as q from routed),
c as (select *, regexp_replace(regexp_replace(q, '\s+', '', 'g'), '^[。！？!?，,；;：:]+|[。！？!?，,；;：:]+$', '', 'g') as tight from s),
r as (select conv_id, turn, case when q = '' then 'empty' when tight in {sql_in(Q.SMALL_TALK)} or (length(tight) <= 14 and {sql_has(Q.SMALL_TALK_PARTS).replace("(q,", "(tight,")}) then 'small_talk'
  when (regexp_matches(q, '{Q.MEMORY_WRITE}') or ({sql_like(Q.MEMORY_CHAT)} and not {sql_has(Q.NEWS)})) and not {sql_has(Q.KNOWLEDGE + Q.ENTITIES)} then 'memory'
  when length(q) <= 5 and not {sql_has(Q.STATISTICS + Q.NEWS + Q.STEPS + Q.KNOWLEDGE)} then 'brief' when {sql_like(Q.GREETINGS)} then 'greeting'
  when {sql_has(Q.STATISTICS)} and {sql_has(Q.ENTITIES)} and not {sql_has(Q.STATISTICS_IN_DOCUMENTS)} then 'statistics' when {sql_has(Q.NEWS)} and not {sql_has(Q.NEWS_IN_DOCUMENTS)} then 'news'
  when length(q) >= 18 and {sql_has(Q.STEPS)} then 'steps' else 'default' end as reason from c)"""


@query(
    "route_query_text",
    f"""with {ROUTED} select conv_id, turn, reason, case reason when 'statistics' then 'sql_query' when 'news' then 'web_search' when 'steps' then 'multi_step' when 'default' then 'knowledge_base' else 'chitchat' end as intent,
  case reason when 'statistics' then 'sql_query' when 'news' then 'web_search' when 'steps' then 'decomposition' when 'default' then 'direct' else 'chitchat' end as strategy,
  case reason when 'statistics' then 'sql_query' when 'news' then 'web_search' when 'steps' then 'kb_search' when 'default' then 'kb_search' else '' end as tools,
  case reason when 'statistics' then 'tool_call' when 'news' then 'tool_call' when 'steps' then 'rag_workflow' when 'default' then 'rag_workflow' else 'chitchat' end as mode, case when reason = 'default' then 0.5 else 1.0 end as confidence from r""",
)
def route_query_text(t):
    return t.routed.select("conv_id", "turn", Q.route(F.col("q")).alias("r")).select("conv_id", "turn", *(f"r.{c}" for c in ("reason", "intent", "strategy", "tools", "mode", "confidence")))


INPUTS["vague"] = """select conv_id, turn, case (conv_id + turn) % 6 when 0 then '请 对比这 两个 文件 ' || text when 1 then '哪个 更好 ' || text when 2 then '哪个更好, A 还是 B ' || text when 3 then '分析这个 ' || text when 4 then '它 是什么' else text end as q from conversations"""


@query(
    "needs_clarification",
    r"""with c as (select conv_id, turn, regexp_replace(q, '\s+', '', 'g') as q from vague), r as (select conv_id, turn, case when regexp_matches(q, '对比这两个|比较这两个') then 'missing_comparison_targets' when contains(q, '哪个更好') and not regexp_matches(q, '和|与|还是|对比|比较') then 'missing_candidates_and_criteria'
  when regexp_matches(q, '总结这个|分析这个|处理这个问题') then 'ambiguous_reference' when regexp_matches(q, '这个|这两个|那个|它|他们|上面|刚才') and length(q) <= 12 then 'short_ambiguous_reference' else '' end as reason from c)
select conv_id, turn, reason <> '' as needed, reason, case reason when 'missing_comparison_targets' then 'comparison_targets' when 'missing_candidates_and_criteria' then 'candidates,criteria' when '' then '' else 'referent' end as slots, case reason when 'missing_comparison_targets' then '你想让我对比哪两个对象？请补充对象名称或对应文档范围。' when 'missing_candidates_and_criteria' then '你想比较哪些候选项？评价标准是性能、成本、稳定性，还是其他维度？' when 'ambiguous_reference' then '这里的“这个”具体指什么？请补充文档、问题对象或上下文范围。' when 'short_ambiguous_reference' then '你这里指的是哪个对象或哪段内容？请补充一下上下文。' else '' end as question from r""".replace("\\\\", "\\"),
)
def needs_clarification(t):
    return t.vague.select("conv_id", "turn", Q.clarification(F.col("q")).alias("c")).select("conv_id", "turn", "c.needed", "c.reason", "c.slots", "c.question")


@query("rewrite_query_text", r"select conv_id, turn, md5('操作流程 ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) as text_md5 from conversations")
def rewrite_query_text(t):
    return t.conversations.select("conv_id", "turn", F.md5(Q.rewrite(F.concat(F.lit(" 怎么弄一下 这个 "), F.col("text")))["rewritten"]).alias("text_md5"))


#: Two texts of a conversation turn beside each other, one of them again in other case, and plain messages.
INPUTS["compound"] = "select conv_id, turn, text, case (conv_id + turn) % 3 when 0 then text || ' TAIL 以及 ' || text || ' tail、' || text || '？与。' when 1 then '比较 Nation' || cast(turn as string) || ' 与 Other Land 和 NATION' || cast(turn as string) else text end as q from conversations"
TRIMMED = r"regexp_replace({0}, '^[\s?？,，。]+|[\s?？,，。]+$', '', 'g')".replace("\\\\", "\\")


@query(
    "decompose_query_text",
    f"""select conv_id, turn, case (conv_id + turn) % 3 when 0 then 2 when 1 then 3 else 1 end as n,
  md5(case (conv_id + turn) % 3 when 0 then {TRIMMED.format("text || ' TAIL '")} || '是什么？' when 1 then 'Nation' || cast(turn as string) || ' 在材料中体现出的核心变化过程、原因和关键表现是什么？' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end) as first_md5,
  md5(case (conv_id + turn) % 3 when 0 then {TRIMMED.format("text")} || '是什么？' when 1 then 'Other Land 在材料中体现出的核心变化过程、原因和关键表现是什么？' end) as second_md5 from compound""",
)
def decompose_query_text(t):
    """Messages hold none of the separators themselves."""
    parts = Q.decompose(F.col("q"))
    return t.compound.select("conv_id", "turn", F.size(parts).alias("n"), F.md5(F.get(parts, F.lit(0))).alias("first_md5"), F.md5(F.get(parts, F.lit(1))).alias("second_md5"))


@query("extract_llm_json", "select doc_id, n_chars, md5(text) as text_md5 from documents")
def extract_llm_json(t):
    """Whole texts inside a model's fenced answer, with braces before and after."""
    payload = F.to_json(F.struct(F.col("n_chars").alias("n"), F.col("text").alias("t"), F.struct(F.lit(1).alias("y")).alias("x")))
    answer = F.concat(F.lit("Sure, "), F.length("text").cast("string"), F.lit(" characters:\n```json\nAnswer: "), payload, F.lit(" ok\n``` done"))
    got = F.from_json(T.llm_json(answer), "n long, t string")
    return t.documents.select("doc_id", got["n"].alias("n_chars"), F.md5(got["t"]).alias("text_md5"))


@query("dedupe_query_batch", r"with k as (select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as q from conversations) select conv_id, turn, md5(q) as norm_md5, count(*) over (partition by q) as asked, conv_id * 100 + turn = min(conv_id * 100 + turn) over (partition by q) as runs, min(conv_id * 100 + turn) over (partition by q) as served_by, length(q) as result from k")
def dedupe_query_batch(t):
    got = goldens.dedupe_query_batch(t.conversations.withColumn("request_id", F.col("conv_id") * 100 + F.col("turn")), "request_id", "text", 10)
    results = got.where("runs").select("request_id", F.length("norm").cast("long").alias("result"))  # what a search would give
    return goldens.fan_back(got, results, "request_id").select("conv_id", "turn", F.md5("norm").alias("norm_md5"), "asked", "runs", "served_by", "result")


@query("normalize_gold", "select item_id, 'p' || cast(item_id as string) || ',p9' as gold, 'q' || cast(item_id as string) as question from benchmark where item_id <> 9 union all select item_id, 'p9', 'q9' from benchmark where item_id = 9")
def normalize_gold(t):
    n = F.col("item_id").cast("string")
    return t.benchmark.select("item_id", F.array_join(goldens.gold_ids([F.array(F.concat(F.lit("p"), n), F.lit(" ")), F.array(F.lit("p9"))], [F.array(F.lit("d1"))]), ",").alias("gold"), T.first_filled(F.lit(" "), F.concat(F.lit("q"), n)).alias("question"))


INPUTS["filings"] = "select c_mktsegment || cast(cast(floor(c_custkey / 200) as bigint) as string) as ticker, c_custkey as pos, case when c_custkey % 3 = 0 then '10-K' when c_custkey % 3 = 1 then '10-Q' else '8-K/A x' end as form, c_name as accession, case when c_custkey % 7 = 0 then '' else cast(2001 + c_custkey % 20 as string) || '-03-01' end as filed from customer"


@query("explode_filing_index", "select ticker, form, accession, case when filed = '' then 'unknown_year' else substr(filed, 1, 4) end as year, 'filings/' || ticker || '/' || replace(replace(form, ' ', '_'), '/', '_') || '/' || case when filed = '' then 'unknown_year' else substr(filed, 1, 4) end || '/' || accession || '_main.htm' as path from (select *, row_number() over (partition by ticker, form order by pos) as nth from filings where form in ('10-K', '8-K/A x')) where nth <= 4")
def explode_filing_index(t):
    rows = t.filings.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("pos", "form", "accession", "filed"))).alias("r"))
    columns = rows.select("ticker", F.col("r.form").alias("form"), F.col("r.filed").alias("filed"), F.concat(F.col("r.accession"), F.array(F.lit("past the shortest"))).alias("accession"))
    found = goldens.explode_filings(columns, ["form", "accession", "filed"], ["10-K", "8-K/A x"], 4)
    year = goldens.filing_year(F.col("filed"))
    return found.select("ticker", "form", "accession", year.alias("year"), goldens.filing_path(F.col("ticker"), F.col("form"), year, F.col("accession"), F.lit("main.htm")).alias("path"))


#: A row a customer and order status, so that it grows with the tables.
INPUTS["metrics_table"] = "select o_custkey as ticker, o_orderstatus as metric, max(o_totalprice) as amount, case when o_custkey % 4 = 0 then '元' else '千元' end as unit from orders group by o_custkey, o_orderstatus"


@query("cross_doc_metrics", "select a.ticker, a.amount as annual, q.amount as quarterly from metrics_table a join metrics_table q on a.ticker = q.ticker where a.metric = 'F' and q.metric = 'O'")
def cross_doc_metrics(t):
    return goldens.cross_doc_metrics(t.metrics_table.where("metric = 'F'"), t.metrics_table.where("metric = 'O'"))


@query("cross_entity_pairs", "select * from (select a.ticker as left_ticker, b.ticker as right_ticker, case when a.unit <> b.unit then 'not comparable' when cast(a.amount as decimal(38,6)) > cast(b.amount as decimal(38,6)) then 'higher' when cast(a.amount as decimal(38,6)) < cast(b.amount as decimal(38,6)) then 'lower' else 'equal' end as relation from metrics_table a join metrics_table b on a.ticker < b.ticker where a.metric = 'F' and b.metric = 'F') order by left_ticker, right_ticker limit 22")
def cross_entity_pairs(t):
    """The cap of 22 pairs belongs to the golden set."""
    return goldens.cross_entity_pairs(t.metrics_table.where("metric = 'F'"), 22)


@query("first_full_report", "select source, lang, min(path) as path from (select source, lang, lpad(cast(doc_id as string), 9, '0') || case when doc_id % 4 = 0 then '摘要' else '' end || '.pdf' as path from documents) where not contains(path, '摘要') group by 1, 2")
def first_full_report(t):
    rows = t.documents.selectExpr("source", "lang", "lpad(cast(doc_id as string), 9, '0') || case when doc_id % 4 = 0 then '摘要' else '' end || '.pdf' as path")
    return goldens.first_full_report(rows, ["source", "lang"], "path").select("source", "lang", "path")


@query("first_page_with", "with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents) select doc_id, min(pos) + 1 as page_no from l where contains(line, 'the') and (contains(line, 'of') or contains(line, 'and')) and pos < 30 group by 1")
def first_page_with(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page_no", F.col("pos") + 1)
    return goldens.first_page_with(rows, [["the"], ["of", "and"]], 30).select("doc_id", "page_no")


REPORT_LINE = "case pos % 8 when 1 then '-' || cast(pos * 1000 as string) || '.5%' when 3 then '同比增加 ' || cast(pos as string) when 5 then '不适用' when 6 then '1,23' else line end as line"
REPORT_LINES = f"select doc_id, pos, {REPORT_LINE} from text_lines"
NUMERIC = r"(regexp_full_match(line, '-?\d{1,3}(,\d{3})*(\.\d+)?%?|-?\d+(\.\d+)?%?') or line = '不适用' or contains(line, '减少') or contains(line, '增加'))".replace("\\\\", "\\")
TEXT_LINES = "text_lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)"
TRIM_LINE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".replace("\\\\", "\\")


def report_lines(t):
    """Lines of documents, some replaced by values as reports have them."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).selectExpr("doc_id", "pos", REPORT_LINE)


@query(
    "labelled_values",
    f"""with {TEXT_LINES}, v as (select doc_id, pos, line, {NUMERIC} as is_value, contains(line, 'the') or contains(line, 'que') as labelled from ({REPORT_LINES})),
f as (select doc_id, min(a.pos) as p from v a where labelled and exists (select 1 from v b where b.doc_id = a.doc_id and b.pos between a.pos + 1 and a.pos + 18 and b.is_value) group by 1)
select v.doc_id, string_agg(line, '|' order by pos) as found from v join f on v.doc_id = f.doc_id and pos between p + 1 and p + 18 and is_value group by 1""",
)
def labelled_values(t):
    return goldens.labelled_values(report_lines(t), ["the", "que"]).withColumn("found", F.array_join("found", "|"))


@query(
    "value_after_label",
    f"""with {TEXT_LINES}, v as (select doc_id, pos, {TRIM_LINE.format("line")} as line from ({REPORT_LINES})),
n as (select *, first_value(case when line not in ('不适用', '1,23') then line end ignore nulls) over (partition by doc_id order by pos rows between 1 following and 7 following) as next, {TRIM_LINE.format("replace(line, '同比增加', '')")} as rest from v),
c as (select doc_id, pos, coalesce(case when rest <> '' and rest not in ('不适用', '1,23', '3') then rest end, next) as value from n where contains(line, '同比增加'))
select doc_id, md5(min_by(value, pos)) as value_md5 from c where value is not null group by 1""".replace("('不适用', '1,23')", "('不适用', '1,23', '3')"),
)
def value_after_label(t):
    got = goldens.value_after_label(report_lines(t), "同比增加", ["不适用", "1,23", "3"])
    return got.select("doc_id", F.md5("value").alias("value_md5"))


@query(
    "snippet_around_label",
    f"""with {TEXT_LINES}, v as (select * from ({REPORT_LINES})), f as (select doc_id, min(case when contains(line, '不适用') or contains(line, 'que') then pos end) as p from v group by 1)
select v.doc_id, md5({TRIM_LINE.format("string_agg(line, chr(10) order by pos)")}) as snippet_md5 from v join f on v.doc_id = f.doc_id and pos >= coalesce(p - 2, 0) and pos < coalesce(p + 10, 10) group by 1""",
)
def snippet_around_label(t):
    got = goldens.snippet_around_label(report_lines(t), ["不适用", "que"])
    return got.select("doc_id", F.md5("snippet").alias("snippet_md5"))


@query("export_eval_bundle", "select 'queries' as part, count(*) as n from benchmark union all select 'qrels', count(*) * 2 from benchmark union all select 'evidence', count(distinct 'e' || cast(item_id % 10 as string)) + count(*) from benchmark")
def export_eval_bundle(t):
    e = lambda name, v: F.struct(name.alias("evidence_id"), v.alias("evidence_text"))
    n = F.col("item_id")
    rows = t.benchmark.select(F.concat(F.lit("q"), n.cast("string")).alias("id"), F.col("text").alias("question"), F.array(e(F.concat(F.lit("e"), (n % 10).cast("string")), F.col("text")), e(F.concat(F.lit("own"), n.cast("string")), F.col("text"))).alias("positive_contexts"))
    return goldens.bundle_counts(*goldens.eval_bundle(rows))


BUNDLED = "select 'q' || cast(item_id as string) as query_id, 'e' || cast(item_id % 10 as string) as evidence_id, text from benchmark union all select 'q' || cast(item_id as string), 'own' || cast(item_id as string), text from benchmark"


def bundle(t):
    e = lambda name, v: F.struct(name.alias("evidence_id"), v.alias("evidence_text"))
    n = F.col("item_id")
    return goldens.eval_bundle(t.benchmark.select(F.concat(F.lit("q"), n.cast("string")).alias("id"), F.col("text").alias("question"), F.array(e(F.concat(F.lit("e"), (n % 10).cast("string")), F.col("text")), e(F.concat(F.lit("own"), n.cast("string")), F.col("text"))).alias("positive_contexts")))


@query("eval_bundle_qrels", f"select query_id, evidence_id from ({BUNDLED})")
def eval_bundle_qrels(t):
    return bundle(t)[1]


@query("eval_bundle_evidence", f"select evidence_id, md5(min_by(text, query_id)) as text_md5 from ({BUNDLED}) group by 1")
def eval_bundle_evidence(t):
    return bundle(t)[2].select("evidence_id", F.md5("evidence_text").alias("text_md5"))

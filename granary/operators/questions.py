"""Golden questions over report metrics, their refinement, and prompt texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.tables import numbered, written
from granary.functions.text import filled, strip, to_decimal

#: Fixed labels of metrics and profile fields.
METRICS = {"revenue": "营业收入", "net_profit": "归属于上市公司股东的净利润", "cashflow": "经营活动产生的现金流量净额", "total_assets": "总资产", "eps": "基本每股收益"}
FIELDS = {"legal_rep": "法定代表人", "website": "官方网站", "registered_address": "注册地址", "stock_code": "A股股票代码"}
#: Fixed question and answer templates by kind.
PROFILE = {
    "legal_rep": ("{company}2025年年度报告披露的法定代表人是谁？", "{company}法定代表人为{value}。"),
    "website": ("{company}2025年年度报告披露的公司网址是什么？", "{company}公司网址为{value}。"),
    "registered_address": ("{company}2025年年度报告披露的注册地址是什么？", "{company}注册地址为{value}。"),
    "stock_code": ("{company}2025年年度报告对应的A股股票代码是什么？", "{company}A股股票代码为{value}。"),
}
ANNUAL = ("{company}2025年年度报告披露的{label}是多少？", "{company}2025年{label}为{value}，单位：{unit}。")
QUARTER = ("{company}2026年第一季度报告披露的{label}是多少？", "{company}2026年第一季度{label}为{value}，单位：{unit}。")
YEARS = ("{company}2025年{label}相比2024年如何变化？请给出两年数值。", "{company}2025年{label}为{value}，2024年为{before}，单位：{unit}。")
CHANGE = "报告披露的同比变化为{change}。"
TWO_REPORTS = ("{company}2025年全年营业收入和2026年第一季度营业收入分别是多少？", "{company}2025年全年营业收入为{value}，单位：{unit}；2026年第一季度营业收入为{q_value}，单位：{q_unit}。")
TWO_COMPANIES = ("{company}和{other}2025年年度报告披露的营业收入分别是多少？哪家公司更高？", "{company}2025年营业收入为{value}，单位：{unit}；{other}2025年营业收入为{o_value}，单位：{o_unit}。")
NOT_COMPARABLE = "两家公司报告披露单位不同或无法直接比较，比较时应先统一单位。"
HIGHER, EQUAL = "在同为{unit}口径下，{name}更高。", "在同为{unit}口径下，两家公司相同。"
NOT_DISCLOSED = ("{company}2025年年度报告是否披露了2027年净利润预测的具体金额？", "未发现{company}2025年年度报告披露2027年净利润预测的具体金额；回答时应说明未披露，不应编造预测数值。")
ONLY_FROM = "只根据{company}2025年年度报告，回答其2025年的{label}，并保留报告披露单位。"
#: Fixed wordings that refined questions have, by type, and what stands for a missing name.
REFINED = {
    "company_profile": "根据{company}2025年年度报告，公司的{field}是什么？",
    "table_numeric": "根据{company}2025年年度报告，{metric}的披露数值是多少？请同时保留报告单位。",
    "quarterly_table_numeric": "根据{company}2026年第一季度报告，{metric}是多少？请回答披露数值和单位。",
    "cross_year_compare": "{company}2025年和2024年的{metric}分别是多少？报告披露的同比变化如何？",
    "cross_doc_multi_hop": "综合{company}2025年年度报告和2026年第一季度报告，全年与一季度的营业收入分别是多少？",
    "cross_company_compare": "请分别查找{left}和{right}2025年年度报告披露的营业收入，说明各自单位，并判断是否可以直接比较。",
    "unanswerable": "只依据{company}2025年年度报告，能否找到2027年净利润预测的具体金额？如果没有披露，请明确说明。",
    "hard_negative_table_numeric": "只依据{company}2025年年度报告正文，找出2025年的{metric}，保留报告披露单位，不要使用一季报或其他公告中的数字。",
}
SOME_COMPANY, SOME_METRIC, SOME_FIELD = "该公司", "相关指标", "公司基本信息"
#: Fixed parts of the prompt.
OPENING = "请基于以下知识库上下文回答用户问题。\n\n"
ANSWERS_HEAD, CONTEXT_HEAD, NO_CONTEXT = "【子问题中间答案】", "【知识库上下文】\n", "未检索到可用知识库上下文。"
DEMANDS = "\n\n【回答要求】\n1. 优先使用知识库上下文，不要编造。\n2. 如果依据不足，说明缺少哪些信息。\n3. 对复杂问题，优先综合中间答案，再结合原始证据补充细节。\n4. 重要结论后可以标注来源编号，例如：[来源 1]。\n\n【用户问题】\n"

CONTEXT = "evidence_id string, doc_id string, page int, evidence_text string, label string, relevance int"


def written_out(template: str, **values: Column) -> Column:
    """The template with columns in place of its {names}."""
    parts = [values[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", template) if x]
    return F.concat(*parts)


def compact(text: Column, most: int) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return strip(F.substring(strip(text), 1, most))


def evidence(label: Column, text: Column, most: int, path: Column | None = None, page: Column | None = None) -> Column:
    """A context struct: what of which page supports an answer, under a stable id."""
    path, page = F.col("rel_path") if path is None else path, F.col("page") if page is None else page
    span = F.lower(F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9一-鿿]+", "_"), "^_+|_+$", ""))
    span = F.coalesce(F.nullif(span, F.lit("")), F.lit("evidence"))
    return F.struct(F.concat(path, F.lit("#page="), page.cast("string"), F.lit("#span="), span).alias("evidence_id"), path.alias("doc_id"), page.cast("int").alias("page"), compact(text, most).alias("evidence_text"), label.alias("label"), F.lit(1).alias("relevance"))


def _record(rows: DataFrame, kind: int, pos: Column, question: Column, answer: Column, contexts: list[Column], difficulty: Column | str, question_type: str, metadata: dict[str, Column | str], eval_type: str = "exact_or_semantic") -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(
        F.struct(F.lit(kind).alias("kind"), F.col("ticker"), pos.cast("int").alias("pos")).alias("order"),
        question.alias("question"),
        answer.alias("answer"),
        "company",
        F.col("ticker").alias("stock_code"),
        lit(difficulty).alias("difficulty"),
        F.lit(question_type).alias("question_type"),
        F.lit(eval_type).alias("eval_type"),
        F.array(*contexts).cast(f"array<struct<{CONTEXT.replace(' ', ':').replace(',:', ', ')}>>").alias("positive_contexts"),
        F.create_map(*(x for k, v in metadata.items() for x in (F.lit(k), lit(v)))).alias("metadata"),
    )


def golden_questions(annual: DataFrame, quarterly: DataFrame, profiles: DataFrame, pairs: int = 22, negatives: int = 12, target: int | None = None, prefix: str = "v2_") -> DataFrame:
    """The golden set: id, question, answer, company, stock_code, difficulty, question_type, eval_type, gold_files,
    gold_pages, gold_evidence, positive_contexts, metadata.

    annual and quarterly: (ticker, company, rel_path, page, unit, page_text, metric, values, snippet), a row a metric, with
    values of this period, the one before, and the change. profiles: (ticker, company, rel_path, page, page_text, field,
    value). Eight kinds of question follow each other, each by ticker: profile fields, annual and quarterly metrics, two
    years, two reports, two companies (the first `pairs`), what is not disclosed (the first `negatives` companies), and
    harder wordings. With a target, the harder ones repeat until it is met, and the set ends there."""
    col, value = F.col, lambda i: F.get("values", F.lit(i))
    annual = annual.where(value(0).isNotNull())
    names = [x for k, v in METRICS.items() for x in (F.lit(k), F.lit(v))]
    label, place = F.create_map(*names)[col("metric")], lambda keys: F.array_position(F.array(*map(F.lit, keys)), col("metric"))
    text = F.coalesce(F.nullif("snippet", F.lit("")), "page_text")
    seen = lambda period: evidence(F.concat(F.lit(f"{period}_"), col("metric")), text, 700)
    shown = {"company": col("company"), "label": label, "value": value(0), "unit": col("unit")}
    some = ["revenue", "net_profit"]
    known = {k: (i, *PROFILE[k]) for i, k in enumerate(PROFILE)}
    by_field = lambda n: reduce(lambda c, k: c.when(col("field") == k, written_out(known[k][n], company=col("company"), value=col("value"))), known, F)
    listed = profiles.where(col("field").isin(list(PROFILE)) & filled(col("value")).isNotNull())
    kinds = [_record(listed, 1, F.array_position(F.array(*map(F.lit, PROFILE)), col("field")), by_field(1), by_field(2), [evidence(F.lit("company_profile"), col("page_text"), 750)], "simple", "company_profile", {"field": col("field")})]
    kinds.append(_record(annual.where(col("metric").isin(list(METRICS))), 2, place(METRICS), written_out(ANNUAL[0], **shown), written_out(ANNUAL[1], **shown), [seen("annual")], F.when(col("metric").isin(some), "simple").otherwise("medium"), "table_numeric", {"metric": col("metric"), "year": "2025"}))
    quarterly = quarterly.where(value(0).isNotNull())
    kinds.append(_record(quarterly.where(col("metric").isin(some)), 3, place(some), written_out(QUARTER[0], **shown), written_out(QUARTER[1], **shown), [seen("q1")], "medium", "quarterly_table_numeric", {"metric": col("metric"), "period": "2026Q1"}))
    change = F.when(filled(value(2)).isNotNull(), written_out(CHANGE, change=value(2))).otherwise("")
    kinds.append(_record(annual.where(col("metric").isin(some) & value(1).isNotNull()), 4, place(some), written_out(YEARS[0], **shown), F.concat(written_out(YEARS[1], before=value(1), **shown), change), [seen("annual")], "complex", "cross_year_compare", {"metric": col("metric"), "years": "2025,2024"}))
    revenue = annual.where("metric = 'revenue'").withColumn("context", seen("annual"))
    first = quarterly.where("metric = 'revenue'").select("ticker", F.get("values", F.lit(0)).alias("q_value"), col("unit").alias("q_unit"), seen("q1").alias("q_context"))
    both = {**shown, "q_value": col("q_value"), "q_unit": col("q_unit")}
    every = {"requires_all_evidence": "true", "metric": "revenue"}
    kinds.append(_record(revenue.join(first, "ticker"), 5, F.lit(0), written_out(TWO_REPORTS[0], **both), written_out(TWO_REPORTS[1], **both), [col("context"), col("q_context")], "multi_hop", "cross_doc_multi_hop", every))
    few = revenue.orderBy("ticker").limit(pairs + 1)  # only the first companies can be in the first pairs
    other = few.select(col("ticker").alias("o_ticker"), col("company").alias("other"), value(0).alias("o_value"), col("unit").alias("o_unit"), col("context").alias("o_context"))
    two = few.join(other, col("ticker") < col("o_ticker")).orderBy("ticker", "o_ticker").limit(pairs)
    mine, theirs = to_decimal(value(0)), to_decimal(col("o_value"))
    of = lambda name: written_out(HIGHER, unit=col("unit"), name=name)
    verdict = F.when(~col("unit").eqNullSafe(col("o_unit")) | mine.isNull() | theirs.isNull(), NOT_COMPARABLE).when(mine > theirs, of(col("company"))).when(theirs > mine, of(col("other"))).otherwise(written_out(EQUAL, unit=col("unit")))
    pair = {**shown, "other": col("other"), "o_value": col("o_value"), "o_unit": col("o_unit")}
    nth = F.dense_rank().over(_in_order("ticker", "o_ticker"))
    kinds.append(_record(two.withColumn("nth", nth), 6, col("nth"), written_out(TWO_COMPANIES[0], **pair), F.concat(written_out(TWO_COMPANIES[1], **pair), verdict), [col("context"), col("o_context")], "multi_hop", "cross_company_compare", every))
    companies = annual.groupBy("ticker").agg(*(F.min(c).alias(c) for c in ("company", "rel_path", "page", "page_text"))).orderBy("ticker").limit(negatives)
    kinds.append(_record(companies, 7, F.lit(0), written_out(NOT_DISCLOSED[0], company=col("company")), written_out(NOT_DISCLOSED[1], company=col("company")), [evidence(F.lit("annual_main_metrics"), col("page_text"), 750)], "negative", "unanswerable", {"hard_negative": "true", "expected_behavior": "answer_not_disclosed"}, "abstention"))
    hint = "same company reports may contain quarterly or summary distractors"
    hard = _record(annual.where(col("metric").isin(list(METRICS)[:4])), 8, place(METRICS), written_out(ONLY_FROM, **shown), written_out(ANNUAL[1], **shown), [seen("annual")], "medium", "hard_negative_table_numeric", {"metric": col("metric"), "hard_negative_hint": hint})
    rows = reduce(DataFrame.unionByName, kinds)
    if target is None:
        out = numbered(written(rows.unionByName(hard), "golden-records"), "order", "place")  # texts are made once, not again to find the ranges
    else:
        out, more = (numbered(written(x, "golden-records"), "order", "place") for x in (rows, hard))
        n, m = out.count(), more.count()
        rounds = max(0, -(-(target - n) // m)) if m else 0
        more = more.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("place", F.lit(n) + F.col("round") * m + F.col("place")).drop("round") if rounds else more.limit(0)
        out = out.unionByName(more).where(F.col("place") < target)
    contexts = col("positive_contexts")
    return out.select(
        F.format_string(f"{prefix}%03d", F.col("place") + 1).alias("id"),
        *("question", "answer", "company", "stock_code", "difficulty", "question_type", "eval_type"),
        F.transform(contexts, lambda c: c["doc_id"]).alias("gold_files"),
        F.transform(contexts, lambda c: c["page"]).alias("gold_pages"),
        F.array_join(F.transform(contexts, lambda c: c["evidence_text"]), "\n\n").alias("gold_evidence"),
        "positive_contexts",
        "metadata",
    )


def _in_order(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)  # over a few rows only


def refine_questions(records: DataFrame, names: DataFrame, prefix: str = "v3_") -> DataFrame:
    """Records with a wording by type that names its scope, new ids in order of the old ones, and where they come from.

    names (ticker, company) gives the companies of a comparison: those of its gold files' first folders, in order; with
    less than two the question stays. Other types keep their question, stripped."""
    files = records.where("question_type = 'cross_company_compare'").select("id", F.posexplode("gold_files").alias("pos", "file"))
    found = files.withColumn("ticker", F.split("file", "/", 2)[0]).join(names.select("ticker", F.col("company").alias("name")).distinct(), "ticker")
    found = found.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])).alias("companies"))
    rows = numbered(records.join(found, "id", "left"), "id", "place")
    named = lambda table, key, other: F.coalesce(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[F.col("metadata")[key]], F.lit(other))
    values = {"company": F.coalesce(filled(F.col("company")), F.lit(SOME_COMPANY)), "metric": named(METRICS, "metric", SOME_METRIC), "field": named(FIELDS, "field", SOME_FIELD), "left": F.get("companies", F.lit(0)), "right": F.get("companies", F.lit(1))}
    text = strip(F.coalesce("question", F.lit("")))
    for kind, template in REFINED.items():
        text = F.when(F.col("question_type") == kind, F.coalesce(written_out(template, **values), F.col("question"))).otherwise(text)
    notes = F.map_concat("metadata", F.create_map(F.lit("refined_from"), F.col("id"), F.lit("question_refinement"), F.lit("more_natural_and_more_explicit_scope")))
    return rows.select(F.format_string(f"{prefix}%03d", F.col("place") + 1).alias("id"), F.col("id").alias("source_eval_id"), text.alias("question"), *(c for c in records.columns if c not in ("id", "question", "metadata")), notes.alias("metadata"))


def build_prompts(questions: DataFrame, snippets: DataFrame, memories: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): memory, intermediate answers, the packed and labelled evidence, what is asked of an answer,
    and the question.

    snippets (query_id, snippet_no, label, text); memories (query_id, context), a text block each; answers (query_id,
    number, question, answer), of which those without a text are left out."""
    block = F.concat(F.lit("[来源 "), F.col("snippet_no").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), F.col("text"))
    packed = snippets.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("snippet_no", block.alias("b")))).alias("s"))
    rows = questions.select("query_id", "question").join(packed, "query_id", "left")
    context = F.coalesce(F.nullif(F.array_join(F.transform("s", lambda x: x["b"]), "\n\n"), F.lit("")), F.lit(NO_CONTEXT))
    memory = said = F.lit("")
    if memories is not None:
        rows, memory = rows.join(memories.select("query_id", "context"), "query_id", "left"), F.coalesce("context", F.lit(""))
    if answers is not None:
        asked, told = (strip(F.coalesce(c, F.lit(""))) for c in ("question", "answer"))
        kept = answers.select("query_id", "number", asked.alias("question"), told.alias("answer")).where("question <> '' or answer <> ''")
        lines = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "question", "answer"))).alias("a"))
        one = lambda x, i: F.concat(F.coalesce(F.nullif(x["number"], F.lit(0)), 2 * i + 1).cast("string"), F.lit(". 子问题："), x["question"], F.lit("\n   中间答案："), x["answer"])
        lines = lines.select("query_id", F.concat(F.lit(ANSWERS_HEAD + "\n"), F.array_join(F.transform("a", one), "\n"), F.lit("\n\n")).alias("said"))
        rows, said = rows.join(lines, "query_id", "left"), F.coalesce("said", F.lit(""))
    return rows.select("query_id", F.concat(F.lit(OPENING), memory, said, F.lit(CONTEXT_HEAD), context, F.lit(DEMANDS), F.col("question")).alias("prompt"))

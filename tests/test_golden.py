"""Small cases worked out by hand."""

import io
import math
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions import queries as Q
from granary.functions import text as T
from granary.operators import blocks as B
from granary.operators import bm25, dense, evaluation, fusion, goldens, memory, rollups, sections
from granary.operators.questions import golden_questions, refine_questions
from granary.sources import parsing

BLOCK = "doc_id string, block_index int, block_type string, text string, page_no int, source_path string, html string, extra map<string,string>, bbox struct<x:double,y:double,w:double,h:double>"


def block(i, kind, text, page=1, bbox=None, extra=None):
    return ("d", i, kind, text, page, "d.pdf", None, extra, bbox)


def one(spark, *columns, text=""):
    return spark.range(1).select(*columns).first()


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([("a", "cat dog cat"), ("b", "dog"), ("c", "!?"), ("d", "中文 dog")], "chunk_id string, text string")
    index = bm25.build_index(rows)
    assert {tuple(r) for r in index.frequencies.collect()} == {("cat", 1), ("dog", 3), ("中", 1), ("文", 1)}
    asked = spark.createDataFrame([("q", "cat cat zebra")], "query_id string, text string")
    (hit,) = bm25.score(index, asked).collect()
    idf, norm = math.log(1 + (3 - 1 + 0.5) / 1.5), 1.5 * (0.25 + 0.75 * 3 / (7 / 3))
    assert hit.chunk_id == "a" and hit.score == pytest.approx(2 * idf * 2 * 2.5 / (2 + norm))


def test_fusion_and_ties(spark):
    hits = lambda ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    got = fusion.rrf_fuse([hits("abc"), hits("bad")], 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0], None])], "chunk_id long, embedding array<float>")
    near = dense.dense_topk(vectors.where("chunk_id = 0").withColumnRenamed("chunk_id", "query_id"), vectors, 2).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in near] == [(0, 1.0), (1, 1.0)]


def test_cross_page_tables(spark):
    head = "| A | B |\n|---|---|\n"
    rows = [block(0, "table", head + "| 1 | 2 |", 1), block(1, "table", head + "| 3 | 4 |", 2), block(2, "text", "x", 2), block(3, "table", "| C | D |\n| 5 | 6 |", 3)]
    got = B.merge_cross_page_tables(spark.createDataFrame(rows, BLOCK)).orderBy("block_index").collect()
    assert [r.block_type for r in got] == ["table", "text", "table"]
    assert got[0].extra["table_id"] == "d::table::0" and got[0].extra["page_range"] == "1-2" and got[0].text.count("| A | B |") == 1 and "| 3 | 4 |" in got[0].text
    assert got[2].extra["table_id"] == "d::table::1"
    marked = B.block_section_text(spark.createDataFrame([tuple(r) + (None,) for r in got], BLOCK)).where("block_index = 0").first().section_text
    assert marked.startswith("[TABLE_ID: d::table::0]\n[TABLE_PAGE_RANGE: 1-2]\n[TABLE_HEADERS: A, B]\n| A | B |")
    parts = sections.table_parts("| A | B |\n| --- | --- |\n" + "\n".join(f"| row {i} | v |" for i in range(12)), 120)
    assert len(parts) > 1 and all(p[2].startswith("| A | B |\n| --- | --- |") and len(p[2]) <= 120 and p[1] == len(parts) for p in parts)


def test_titles(spark):
    rows = [block(0, "title", "A"), block(1, "title", "B"), block(2, "title", "Rest"), block(3, "title", "C"), block(4, "text", "body"), block(5, "title", "D")]
    got = B.merge_title_fragments(spark.createDataFrame(rows, BLOCK)).orderBy("block_index").collect()
    assert [(r.block_type, r.text) for r in got] == [("title", "ABRest"), ("text", "C"), ("text", "body"), ("text", "D")]
    near = [block(0, "title", "Long one", bbox=(1.0, 0.0, 9.0, 10.0)), block(1, "title", "goes on", bbox=(5.0, 20.0, 9.0, 10.0)), block(2, "title", "apart", bbox=(99.0, 30.0, 9.0, 9.0)), block(3, "title", "a, b")]
    got = B.fix_titles(spark.createDataFrame(near, BLOCK)).orderBy("block_index").collect()
    assert [(r.block_type, r.text) for r in got] == [("title", "Long onegoes on"), ("title", "apart"), ("text", "a, b")]


def test_html_and_docx(spark):
    page = "<title>T &amp; x</title><nav>n<script>s</script>n</nav><p>one <a href='/u'>link</a><li>item<table><tr><th>h</th><td>2</td></tr><tr><td>  </td></tr><tr><td>3</td></tr></table><div>open"
    assert parsing.blocks_of_html(page) == [("title", "T & x", "title"), ("text", "one link (/u)", "p"), ("list_item", "item", "li"), ("table", "| h | 2 |\n| --- | --- |\n| 3 |  |", "table"), ("text", "open", "div")]
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in (("Heading1", "Head"), ("ListBullet", "point"), ("Normal", "text")))
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(data := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", xml)
    files = spark.createDataFrame([("good", data.getvalue()), ("bad", b"zip?"), ("none", None)], "path string, content binary")
    got = parsing.docx_blocks(files).orderBy("doc_id", "block_index").collect()
    assert [(r.doc_id, r.block_type, bool(r.error)) for r in got] == [("bad", None, True), ("good", "title", False), ("good", "list_item", False), ("good", "text", False), ("good", "table", False)]
    assert parsing.html_to_markdown(spark.createDataFrame([(1, None, "u"), (2, "plain", "u")], "page_id int, html string, url string")).orderBy("page_id").collect()[1].markdown.endswith("plain")


def test_sections_and_chunks():
    b = lambda i, kind, text, page=1: {"block_index": i, "block_type": kind, "text": text, "section_text": ("## " if kind == "title" else "") + text, "page_no": page}
    exact = sections.pack_sections([b(0, "title", "Chapter 1"), b(1, "text", "x" * 900), b(2, "title", "Chapter 2", 2), b(3, "text", "y" * 900, 3)], 4000, 800)
    assert [(s[1], s[3]) for s in exact] == [("Chapter 1", "1"), ("Chapter 2", "2-3")]
    assert len(sections.pack_sections([b(0, "text", "x" * 4000), b(1, "text", "y")], 4000, 0)) == 2
    assert len(sections.pack_sections([b(0, "text", "x" * 3999), b(1, "text", "y")], 4000, 0)) == 1
    assert len(sections.pack_sections([b(0, "title", "Only"), b(1, "title", "Next"), b(2, "text", "z" * 900)], 4000, 800)) == 1
    text = " ".join(f"Word{i} goes here." for i in range(900))
    tree = sections.chunk_tree("d", text, (2048, 512, 128), 50)
    by = {c[0]: c for c in tree}
    assert all(c[1] is None or c[5] in by[c[1]][5] for c in tree) and {c[2] for c in tree} == {"root", "parent", "leaf"}


def test_text_functions(spark):
    pages = lambda s: one(spark, T.page_numbers(F.lit(s)))[0]
    assert pages("3, 5-7; 9") == [3, 5, 6, 7, 9] and pages("9–8") == [8, 9] and pages("x") == [] and pages("") == []
    both = lambda a, b: one(spark, T.evidence_overlap(F.lit(a), F.lit(b)))[0]
    assert both("abc", "AB C") == 1.0 and both("", "abc") == 0.0 and both("abcd", "wxyz") == 0.0 and both("abcd", "bcdx") == 0.5
    assert one(spark, T.normalize_spaces(F.lit("​a\t b\n\n\n\nc ")))[0] == "a b\n\nc"
    assert one(spark, T.llm_json(F.lit('say ```json\n{"a": {"b": 1}}\n``` ok')))[0] == '{"a": {"b": 1}}'
    assert [r[0] for r in spark.createDataFrame([("第一章 总则",), ("3.1 Scope",), ("plain words",)], "t string").select(B.any_like(F.col("t"), B.HEADINGS)).collect()] == [True, True, False]


@pytest.mark.parametrize(
    "text, intent",
    [("你好", "chitchat"), ("Hello!", "chitchat"), ("请记住我喜欢短答案", "chitchat"), ("统计用户数量", "sql_query"), ("最新的新闻有哪些内容", "web_search"), ("知识库里最新的制度是什么", "knowledge_base"), ("请对比两种方案并分析它们各自的优缺点和适用场景", "multi_step"), ("合同的违约责任如何规定", "knowledge_base"), ("", "chitchat")],
)
def test_router(spark, text, intent):
    assert one(spark, Q.route(F.lit(text))["intent"])[0] == intent


def test_rewrite_and_decompose(spark):
    got = one(spark, Q.rewrite(F.lit("这个 怎么弄 一下  API 啥意思")))[0]
    assert got.rewritten == "操作流程 API 定义 含义" and got.keywords == ["操作流程", "API", "定义", "含义"]
    parts = lambda s: one(spark, Q.decompose(F.lit(s)))[0]
    assert len(parts("compare Chloroplast and East New York")) == 3 and parts("苹果和香蕉") == ["苹果是什么？", "香蕉是什么？"] and parts("plain") == ["plain"]


def test_quality_thresholds(spark):
    asked = spark.createDataFrame([(q,) for q in ("none", "low", "edge", "short")], "query_id string")
    hit = lambda q, score, text: (q, 1, score, text, f"{q}.txt", False)
    hits = spark.createDataFrame([hit("low", 0.15, "x" * 200), hit("edge", 0.3, "x" * 100), hit("short", 0.9, " abc ")], "query_id string, rank int, score double, text string, source_path string, auto_merged boolean")
    got = {r.query_id: (r.quality, r.reason) for r in fusion.retrieval_quality(asked, hits).collect()}
    assert got == {"none": ("bad", "empty"), "low": ("bad", "low_top1"), "edge": ("good", "good"), "short": ("bad", "short_text")}


def test_wildcard_recall(spark):
    matches = spark.createDataFrame([("q", 2, True, ["text_overlap"]), ("p", 4, True, ["a1"])], "query_id string, rank int, matched boolean, anchor_ids array<string>")
    got = {r.query_id: r for r in evaluation.anchor_metrics_at_k(matches, spark.createDataFrame([("q", 3), ("p", 2), ("n", 1)], "query_id string, anchors int")).collect()}
    assert (got["q"].recall_1, got["q"].recall_3, got["q"].mrr_3) == (0.0, 1.0, 0.5)
    assert (got["p"].recall_3, got["p"].recall_5, got["n"].recall_10, got["n"].first_hit_rank) == (0.0, 0.5, 0.0, None)


def test_summary_budget(spark):
    rows = spark.createDataFrame([(1, i, "user", "x" * 2000, "completed") for i in range(10)], "session_id int, message_id long, role string, content string, status string")
    text = memory.summary_input(rows).first().summary_input
    assert sum(map(len, text.split("\n"))) == 6000


def test_block_quality_flags(spark):
    """Levels and flags by the quality report's rules: scans and empty results are poor, any other flag asks for review."""
    rows = [
        *(("scan", i, "text", "x" * 300, 1) for i in range(2)),
        ("two", 0, "table", "t" * 150, 1), ("two", 1, "text", "between", 1), ("two", 2, "table", "t" * 150, 2), ("two", 3, "image", "", 2),
        ("gap", 0, "table", "t" * 150, 1), ("gap", 1, "table", "t" * 150, None), ("gap", 2, "table", "t" * 150, 2),
        ("bare", 0, "text", "y" * 250, None), ("bare", 1, "text", "y", 1),
        ("sparse", 0, "text", " few words ", 1),
        ("fine", 0, "title", "A", 3), ("fine", 1, "text", "z" * 250, 5),
    ]
    blocks = spark.createDataFrame(rows, "doc_id string, block_index int, block_type string, text string, page_no int")
    probes = spark.createDataFrame([("scan", True), ("fine", False)], "doc_id string, is_scanned boolean")
    documents = spark.createDataFrame([(d,) for d in ("scan", "two", "gap", "bare", "sparse", "fine", "none")], "doc_id string")
    got = {r.doc_id: r for r in B.block_quality(blocks, probes, documents).collect()}
    assert {d: (r.level, r.flags) for d, r in got.items()} == {
        "scan": ("poor", "scanned_pdf_requires_ocr"),
        "two": ("needs_review", "table_blocks_present,cross_page_table_candidate,image_blocks_present"),
        "gap": ("needs_review", "table_blocks_present"),
        "bare": ("needs_review", "missing_page_metadata"),
        "sparse": ("needs_review", "very_sparse_text"),
        "fine": ("ok", ""),
        "none": ("poor", "empty_parse_result"),
    }
    assert got["sparse"].mean_chars == 9.0 and got["two"].mean_chars == 102.33 and got["fine"].page_range == "3-5" and got["none"].mean_chars == 0


def test_audit_counts_texts_as_they_stand(spark):
    rows = [("a", 0, "x", "table_numeric", "easy"), ("a", 2, "x", "profile", "easy"), ("A", 1, "abstention", None, ""), ("单位是", 1, "x", "hard_negative_table_numeric", "hard"), (None, None, "x", "table_numeric", "hard"), ("", 3, "x", "table", "hard")]
    questions = spark.createDataFrame(rows, "question string, n_contexts int, eval_type string, question_type string, difficulty string")
    got = evaluation.eval_set_audit(questions).first().asDict()
    assert got == {"questions": 6, "multi_evidence": 2, "abstentions": 1, "missing_contexts": 2, "numeric_without_unit": 2, "distinct_questions": 4, "duplicated": 2}
    assert {tuple(r) for r in evaluation.eval_set_counts(questions).where("slice = 'difficulty'").collect()} == {("difficulty", "easy", 2), ("difficulty", "unknown", 1), ("difficulty", "hard", 3)}


def test_decompose_ignores_case_of_repeats(spark):
    split = lambda q: one(spark, Q.decompose(F.lit(q)))[0]
    assert split("Alpha plan、alpha PLAN、beta？") == ["Alpha plan是什么？", "beta是什么？"]
    assert split("比较 Foo 与 Bar 和 FOO") == ["Foo 在材料中体现出的核心变化过程、原因和关键表现是什么？", "Bar 在材料中体现出的核心变化过程、原因和关键表现是什么？", "Foo 和 Bar 体现出的变化过程有哪些共同点和差异？"]
    assert split("plain question") == ["plain question"] and split(" ") == []


def test_labels_and_values(spark):
    lines = lambda *rows: spark.createDataFrame([("d", i, x) for i, x in enumerate(rows)], "doc_id string, pos int, line string")
    one_of = lambda df: df.first()[1] if df.count() else None
    assert one_of(goldens.labelled_values(lines("revenue", "1,234.5", "12,34", "同比增加 3", "-7%", "不适用", "n不适用", "(5)"), ["revenue", "income"])) == ["1,234.5", "同比增加 3", "-7%", "不适用"]
    assert one_of(goldens.labelled_values(lines("revenue", "text", "net income", "9"), ["revenue"])) == ["9"] and one_of(goldens.labelled_values(lines("x", "9"), ["revenue"])) is None
    assert one_of(goldens.value_after_label(lines("Name: Li", "x"), "Name:")) == "Li"
    assert one_of(goldens.value_after_label(lines("Name:", "N/A", "Wu", "x"), "Name:", ["N/A"])) == "Wu"
    assert one_of(goldens.value_after_label(lines("Name:", *["N/A"] * 8, "late", "Name: N/A", "Name: Xu"), "Name:", ["N/A"])) == "Name: Xu"  # the line after a skipped rest, whole
    assert one_of(goldens.snippet_around_label(lines("a", "b", "c", "hit", "d"), ["hit"], 2)) == "b\nc\nhit\nd" and one_of(goldens.snippet_around_label(lines("a", "b", "c"), ["hit"], 2)) == "a\nb"


def test_trace_sums_and_counts(spark):
    shape = "retriever_core_ms double, retrieval_total_profiled_ms double, fallback boolean, fallback_reasons array<string>, cache struct<enabled:boolean,hit:boolean>, postprocessors array<struct<timing_key:string,duration_ms:double>>"
    rows = [(5.0, 9.0, True, ["slow", "empty"], (True, False), [("rerank_ms", 2.0), ("", 7.0)]), (3.0, 0.0, False, None, (True, True), None), (None, None, None, ["slow"], None, [("rerank_ms", None), ("x_ms", 1.5)])]
    profiles = spark.createDataFrame(rows, shape)
    assert {tuple(r) for r in rollups.trace_rollup(profiles).collect()} == {("retriever_core_ms", 8.0, 3), ("retrieval_profiled_ms", 12.0, 3), ("rerank_ms", 2.0, 2), ("x_ms", 1.5, 1)}
    assert tuple(rollups.trace_counts(profiles).first()) == (3, 1, True, 1, 1)
    assert {tuple(r) for r in rollups.fallback_reasons(profiles).collect()} == {("slow", 2), ("empty", 1)}
    keys = one(spark, *(rollups.timing_key(F.lit(x)) for x in ("LLMRerank", "AutoMergingRetriever", "Parent_Context x", "Table Context+")))
    assert tuple(keys) == ("rerank_ms", "auto_merge_ms", "parent_context_ms", "table_context_ms")


def test_dense_search_in_query_blocks(spark):
    """More queries than a block holds, and a vector with very many copies: the same rows as from a single block."""
    vectors = spark.createDataFrame([(i, [1.0, float(i % 7), 0.5]) for i in range(300)], "chunk_id long, embedding array<float>")
    asked = vectors.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    got = {n: sorted(map(tuple, dense.dense_topk(asked, vectors, 5, block_queries=n).select("query_id", "chunk_id", "rank").collect())) for n in (7, 1000)}
    assert got[7] == got[1000] and [c for q, c, _ in got[7] if q == 3] == [3, 10, 17, 24, 31]


def test_dense_search_multiplies_few_rows_at_a_time(spark, monkeypatch):
    """A batch is cut, so what is held doesn't follow the batch's size; the rows are the same."""
    vectors = spark.range(3000).selectExpr("id as chunk_id", "array(cast(sin(id) as float), cast(cos(id * 3) as float), cast(id % 5 as float)) as embedding").coalesce(1)
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for n in (100_000, 16):
        monkeypatch.setattr(dense, "ROW_SLICE", n)
        got[n] = sorted(map(tuple, dense.dense_topk(asked, vectors, 7).select("query_id", "chunk_id", "rank").collect()))
    assert got[16] == got[100_000] and len(got[16]) == 30 * 7


def test_golden_set_repeats_harder_questions_up_to_its_target(spark):
    metric = "ticker string, company string, rel_path string, page int, unit string, page_text string, metric string, values array<string>, snippet string"
    annual = spark.createDataFrame([(k, f"C{k}", f"{k}/a.pdf", 2, "元", "page", m, v, "") for k, v in (("1", ["5", "4", "25%"]), ("2", ["7"])) for m in ("revenue", "eps")], metric)
    quarterly = spark.createDataFrame([("2", "C2", "2/q.pdf", 3, "千元", "page", "revenue", ["1"], "q")], metric)
    profiles = spark.createDataFrame([("1", "C1", "1/a.pdf", 1, "page", "website", "w.cn"), ("1", "C1", "1/a.pdf", 1, "page", "legal_rep", " ")], "ticker string, company string, rel_path string, page int, page_text string, field string, value string")
    got = golden_questions(annual, quarterly, profiles, target=14).orderBy("id").collect()
    assert [r.question_type for r in got] == ["company_profile", *["table_numeric"] * 4, "quarterly_table_numeric", "cross_year_compare", "cross_doc_multi_hop", "cross_company_compare", *["unanswerable"] * 2, *["hard_negative_table_numeric"] * 3]
    assert got[0].answer == "C1公司网址为w.cn。" and got[6].answer == "C12025年营业收入为5，2024年为4，单位：元。报告披露的同比变化为25%。" and got[8].answer.endswith("在同为元口径下，C2更高。")
    assert got[7].gold_files == ["2/a.pdf", "2/q.pdf"] and got[7].positive_contexts[1].evidence_id == "2/q.pdf#page=3#span=q1_revenue"
    assert [r.question for r in got[11:]] == [f"只根据C{k}2025年年度报告，回答其2025年的营业收入，并保留报告披露单位。" for k in (1, 2, 1)]
    assert golden_questions(annual, quarterly, profiles, target=3).count() == 3
    refined = {r.source_eval_id: r.question for r in refine_questions(golden_questions(annual, quarterly, profiles, target=14), annual.select("ticker", "company")).collect()}
    assert refined["v2_001"] == "根据C12025年年度报告，公司的官方网站是什么？" and refined["v2_009"] == "请分别查找C1和C22025年年度报告披露的营业收入，说明各自单位，并判断是否可以直接比较。"


def test_golden_texts_are_made_once(spark, monkeypatch):
    """What is numbered is a written table: finding the ranges of its order reads keys, and makes no text again."""
    from granary.operators import questions

    plans, real = [], questions.numbered
    monkeypatch.setattr(questions, "numbered", lambda df, *names: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *names))
    page = "ticker string, company string, rel_path string, page int, page_text string"
    metrics = spark.createDataFrame([("1", "C1", "1/a.pdf", 2, "page", "u", "revenue", ["5", "4"], "")], f"{page}, unit string, metric string, values array<string>, snippet string")
    profiles = spark.createDataFrame([("1", "C1", "1/a.pdf", 1, "page", "website", "w.cn")], f"{page}, field string, value string")
    assert questions.golden_questions(metrics, metrics, profiles).count() == 7
    assert len(plans) == 1 and "Relation" in plans[0] and "Union" not in plans[0]


def test_rows_of_a_merged_table_are_worked_out_once(spark):
    """Its rows and their width are columns: no row of a table puts its parts together again."""
    rows = spark.createDataFrame([block(i, "table", f"| a | b |\n| --- | --- |\n| {i} | |", i + 1) for i in range(3)], BLOCK)
    got = B.merge_cross_page_tables(rows)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    assert [r.text for r in got.collect()] == ["| a | b |\n| --- | --- |\n| 0 |  |\n| 1 |  |\n| 2 |  |"]


def test_gram_overlaps_equal_the_column_function(spark):
    pairs = [(1, "abc", "AB C"), (2, "", "abc"), (3, None, None), (4, "abcd", "bcdx"), (5, "ab", "abc"), (6, "第一章 总则", "总则第一章"), (7, "x" * 9, "xxx"), (None, "q w e r", "wert")]
    rows = spark.createDataFrame(pairs, "id long, a string, b string")
    want = rows.select("id", T.evidence_overlap(F.col("a"), F.col("b")).alias("overlap")).collect()
    assert sorted(map(str, evaluation.gram_overlaps(rows, "id", "a", "b").collect())) == sorted(map(str, want))


def test_workers_take_few_rows_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150))], ["x"])
    assert [b.num_rows for b in parsing.slices([batch, batch.slice(0, 0)])] == [64, 64, 22]

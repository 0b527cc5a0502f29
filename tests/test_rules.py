"""Rules worked out by hand, and stores and sketches batch by batch."""

import json

import pytest
from pyspark.sql import functions as F

from granary.functions import queries as Q
from granary.operators import evaluation as E
from granary.operators import goldens, memory, rollups
from granary.operators.sections import build_sections, split_large_tables
from granary.sources.chunk_store import ChunkStore


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


CHUNK = "chunk_id string, doc_id string, text string"


def test_chunk_store_rewrites_only_what_a_batch_touches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, f"{CHUNK}, seq int")
    store = ChunkStore(spark, f"{tmp_path}/store", CHUNK, 8)
    assert store.rows().count() == 0 and store.upsert(frame([]), "seq") == []
    first = [(f"c{i}", "d", f"text {i}", i) for i in range(60)]
    assert store.upsert(frame(first), "seq") == list(range(8))
    names = set(store.rows().inputFiles())
    second = [("c3", "d", "new", 1), ("c3", "d", "newer", 2), ("c99", "d", "added", 1), ("c4", "d", "  ", 1), (None, "d", "x", 1), ("c5", "", "x", 1)]
    touched = store.upsert(frame(second), "seq")
    assert 0 < len(touched) <= 2
    kept = {f for f in names if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept and kept <= set(store.rows().inputFiles())
    want = {f"c{i}": f"text {i}" for i in range(60)} | {"c3": "newer", "c99": "added"}
    assert {r.chunk_id: r.text for r in store.rows().collect()} == want and store.rows().count() == 61
    before = set(store.rows().inputFiles())
    broken = frame([("c7", "d", "x", 1)]).withColumn("text", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.upsert(broken, "seq")
    assert set(store.rows().inputFiles()) == before and {r.chunk_id: r.text for r in store.rows().collect()} == want
    rebuilt = ChunkStore(spark, f"{tmp_path}/other", CHUNK, 8)
    rebuilt.upsert(frame([*first[:3], *first[4:], ("c3", "d", "newer", 2), ("c99", "d", "added", 1)]), "seq")
    assert rows_of(rebuilt.rows()) == rows_of(store.rows())


def test_sketches_merge_and_keep_their_error(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, F.lit("a")).when(F.col("doc_id") % 3 == 1, F.lit(" b")))
    by = ["source", "kind"]
    whole = rollups.length_sketches(docs, by)
    halves = rollups.length_sketches(docs.where("doc_id % 2 = 0"), by).unionByName(rollups.length_sketches(docs.where("doc_id % 2 = 1"), by))
    merged = rollups.merged_sketches(halves)
    assert rows_of(merged.drop("sketch")) == rows_of(whole.drop("sketch"))
    exact = {(r.dimension, r.value): r for r in rollups.length_stats_by(docs, by).collect()}
    assert {k for k in exact if k[0] != "source"} == {("all", ""), ("kind", "a"), ("kind", " b"), ("kind", "unknown")}
    for r in rollups.sketched_stats(merged).collect():  # fewer rows than the sketch's size: nothing is thinned out
        want = exact[r.dimension, r.value]
        assert (r["count"], r["mean"], r["min"], r["max"], r["short"], r["long"]) == (want["count"], want["mean"], want["min"], want["max"], want["short"], want["long"])
        assert all(want["min"] <= r[f"p{p}"] <= want["max"] for p in (50, 90, 95))
        assert want["count"] < 100 or abs(r["p50"] - want["p50"]) <= 0.05 * want["max"]


def test_grounding_takes_any_shape(spark):
    cases = {
        "list": ({"claims": [{"claim": "a", "verdict": " Supported "}, {"claim": 5, "verdict": "partial"}, "text", 7, None, ["x"]], "summary": 3}, (0.75, "warning", [])),
        "numbers": ({"claims": [{"claim": 12, "verdict": 1}, {"claim": 0}, {"verdict": "unsupported", "claim": None}]}, (0.0, "fail", ["12"])),
        "missing": ({"other": 1}, (0.0, "fail", [])),
        "no list": ({"claims": {"claim": "a", "verdict": "supported"}}, (0.0, "fail", [])),
        "top list": ([{"claims": []}], (0.0, "fail", [])),
        "against": ({"claims": [{"claim": "a", "verdict": "contradicted"}] + [{"claim": "b", "verdict": "supported"}] * 9}, (0.9, "fail", ["a"])),
        "more keys": ({"claims": [{"claim": "a", "verdict": "supported", "evidence_ids": [1], "x": {"y": []}}]}, (1.0, "pass", [])),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("broken", "{"), ("empty", ""), ("none", None)]
    got = {r.answer_id: (r.grounding_score, r.verdict, r.unsupported) for r in E.grounding_score(spark.createDataFrame(rows, "answer_id string, payload string")).collect()}
    assert got == {k: w for k, (_, w) in cases.items()} | {k: (0.0, "fail", []) for k in ("broken", "empty", "none")}


def grams(text):
    t = "".join(text.split()).lower()
    return {t[i : i + 3] for i in range(len(t) - 2)} if len(t) > 3 else {t} - {""}


def test_judgements_equal_brute_force_in_blocks(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    nodes = [(f"n{i}", f"p{i % 4}" if i % 5 else None, s, t) for i, t, s in docs] + [("same1", None, "s", "Alpha beta"), ("same2", None, "s", "alpha  BETA"), ("short", None, "s", "ab"), ("none", None, "s", None), ("lost", None, None, "alpha")]
    evidence = [(i, f"e{i}", s, t[:80]) for i, t, s in docs[:20]] + [(100, "x", "s", "alphabet"), (101, "y", "s", "ab"), (102, "z", "s", ""), (103, "w", "nowhere", "text"), (104, "v", "s", "alphabetagamma"), (105, "u", "s", None)]
    n = spark.createDataFrame(nodes, "node_id string, parent_id string, path string, text string").repartition(3)
    e = spark.createDataFrame(evidence, "query_id long, evidence_id string, path string, evidence_text string")
    want, diagnosed = [], []
    for q, name, path, text in evidence:
        scored = []
        for node, parent, p, t in nodes:
            a, b = grams(text or ""), grams(t or "")
            if p == path and p is not None and a and b and a & b:
                scored.append((-len(a & b) / min(len(a), len(b)), node, parent))
        scored.sort(key=lambda x: x[:2])
        want += [(q, name, node, parent, -s, k + 1) for k, (s, node, parent) in enumerate(scored[:3])]
        good = [s for s, *_ in scored[:3] if -s >= 0.25]
        diagnosed.append((q, name, path, sum(x[2] == path for x in nodes), len(good) or min(1, len(scored)), round(-scored[0][0], 4) if scored else 0.0, bool(scored) and not good))
    for chars in (16_000_000, 300):
        best = E.best_nodes(e, n, 3, chars)
        assert rows_of(best.select("query_id", "evidence_id", "node_id", "parent_id", "score", "place")) == sorted(want, key=str)
    found = E.node_qrels_diagnostics(e, n, best=best)
    assert rows_of(found) == sorted(diagnosed, key=str)
    qrels = E.build_node_qrels(e, n, best=best)
    summary = E.node_qrels_summary(qrels, found, n).first().asDict()
    assert summary == {"question_count": len(evidence), "unmapped_evidence_count": sum(d[4] == 0 for d in diagnosed), "fallback_best_count": sum(d[6] for d in diagnosed), "node_count": len(nodes), "qrel_row_count": qrels.count()}
    assert E.best_nodes(e.limit(0), n).count() == 0 and E.best_nodes(e, n.limit(0)).count() == 0


def test_texts_of_three_characters_are_the_trigram_they_spell(spark):
    n = spark.createDataFrame([("n1", None, "s", "A b\nc"), ("n2", None, "s", "xx"), ("n3", None, "s", "cde xx")], "node_id string, parent_id string, path string, text string")
    e = spark.createDataFrame([(1, "e1", "s", "xabcy"), (2, "e2", "s", "xcbay"), (3, "e3", "s", "cde"), (4, "e4", "s", "ab")], "query_id long, evidence_id string, path string, evidence_text string")
    best = E.best_nodes(e, n)
    assert rows_of(best.select("query_id", "node_id", "score")) == [(1, "n1", 1.0), (3, "n3", 1.0)]
    assert rows_of(E.node_qrels_diagnostics(e, n, best=best).select("query_id", "selected_count")) == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_brief_sections_join_their_neighbours(spark):
    long, mid = "x" * 900, "y" * 200
    block = lambda i, kind, text, page=None: ("d", i, kind, text, f"## {text}" if kind == "title" else text, page)
    schema = "doc_id string, block_index int, block_type string, text string, section_text string, page_no int"
    run = lambda rows: [(r.section_title, r.element_type, r.first_block, r.last_block, r.page_range) for r in build_sections(spark.createDataFrame(rows, schema)).orderBy("section_index").collect()]
    # a heading alone waits for what follows, and takes its type
    assert run([block(0, "title", "Intro", 1), block(1, "title", "Data", 1), block(2, "table", long, 2)]) == [("Intro", "table", 0, 2, "1-2")]
    # two real bodies stay apart at a chapter heading; the last brief one goes backwards where no chapter begins
    assert run([block(0, "title", "One"), block(1, "text", mid), block(2, "title", "Chapter 2"), block(3, "table", mid)]) == [("One", "text", 0, 1, ""), ("Chapter 2", "table", 2, 3, "")]
    assert run([block(0, "title", "One"), block(1, "text", long), block(2, "title", "Tail"), block(3, "table", mid)]) == [("One", "text", 0, 3, "")]
    # five brief ones: pairs in the first round, the last goes backwards; then the two that are left
    assert run([b for i in range(5) for b in (block(2 * i, "title", f"T{i}"), block(2 * i + 1, "text", mid))]) == [("T0", "text", 0, 9, "")]


def test_table_parts_keep_what_names_them(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'v' * 40} |" for i in range(10))
    rows = [("d", 0, "table", table, {"table_id": " t1 "}), ("d", 1, "text", "plain", None), ("d", 2, "table", "| a |\n| --- |\n| 1 |", {})]
    got = split_large_tables(spark.createDataFrame(rows, "doc_id string, block_index int, block_type string, text string, extra map<string,string>"), 250).orderBy("block_index", "part_index").collect()
    parts = [r for r in got if r.block_index == 0]
    assert len(parts) > 1 and all(r.table_id == "t1" and r.headers == ["a", "b"] and r.part_count == len(parts) and len(r.text) <= 250 for r in parts)
    assert sum(r.row_count for r in parts) == 10 and [r.row_count for r in parts] == [r.text.count("\n") - 1 for r in parts]
    assert [(r.part_count, r.table_id, r.headers, r.row_count) for r in got[len(parts) :]] == [(1, "", None, None)] * 2


def test_query_rules(spark):
    one = lambda f, text: spark.range(1).select(f(F.lit(text)).alias("x")).first().x
    assert one(Q.decompose, "compare apples versus pears") == ["apples是什么？", "pears是什么？"]
    assert one(Q.decompose, "take this Versus that") == ["take this Versus that"]
    asked = one(Q.clarified, "这几款手机产品里面到底哪个更好")
    assert (asked.needed, asked.reason) == (True, "missing_candidates_and_criteria") and asked.question.startswith("你想比较哪些候选项")
    assert one(Q.clarified, "你好") == (False, "", "", "")


def test_results_are_fanned_back(spark):
    asked = goldens.dedupe_query_batch(spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, "c")], "id long, q string"), "id", "q", 5)
    got = goldens.fan_back(asked, spark.createDataFrame([(1, "x"), (1, "y")], "id long, hit string"), "id")
    assert rows_of(got.select("id", "served_by", "hit")) == [(1, 1, "x"), (1, 1, "y"), (2, 1, "x"), (2, 1, "y"), (3, 3, None)]


def test_why_a_session_is_not_compressed(spark):
    messages = [(1, i, "user", "x" * 1000, "completed") for i in range(12)] + [(2, i, "user", "x", "completed") for i in range(13)] + [(3, i, "user", None, "completed") for i in range(13)]
    m = spark.createDataFrame(messages, "session_id long, message_id long, role string, content string, status string")
    s = spark.createDataFrame([(3, 6, 7)], "session_id long, covered_until_message_id long, covered_message_count long")
    got = {r.session_id: (r.should_compress, r.skip_reason, r.estimated_tokens, r.token_trigger) for r in memory.compression_plan(m, s).collect()}
    assert got == {1: (False, "message_count_not_exceed_trigger", 3000, True), 2: (True, "", 3, False), 3: (False, "no_new_messages_after_summary_boundary", 0, False)}


def test_run_report_counts_while_it_writes(spark, tmp_path):
    from granary.sources import files

    chunks = spark.createDataFrame([("r", "d", "root", "x" * 5000), ("a", "d", "leaf", " " + "y" * 40), ("b", "d", "leaf", "z" * 60), ("c", "e", "leaf", None)], "chunk_id string, doc_id string, chunk_role string, text string")
    sections = spark.createDataFrame([("d", "s" * 900), ("d", "t" * 10), ("f", "u" * 5000)], "doc_id string, text string")
    items = spark.createDataFrame([(".txt", "success", "chunk", 3, 2), (".pdf", "failed", "parse", 1, None)], "file_type string, status string, stage string, block_count int, chunk_count int")
    said = files.write_run(chunks, sections, items, f"{tmp_path}/run", {"run_id": "r1"})
    stored = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/run/report").collect()))
    assert stored == json.loads(json.dumps(said)) and stored["run_id"] == "r1"
    assert stored["chunk_stats"] == {"short_threshold": 50, "long_threshold": 1500, "short_count": 2, "long_count": 1, "count": 4, "avg_length": 1275.0, "p50_length": 40, "p90_length": 5000, "p95_length": 5000, "min_length": 0, "max_length": 5000}
    assert (stored["section_stats"]["count"], stored["section_stats"]["short_count"], stored["section_stats"]["long_count"]) == (3, 1, 1)
    assert stored["hierarchy_stats"]["leaf"]["count"] == 3 and stored["hierarchy_stats"]["parent"] == {"count": 0, "avg_length": 0.0, "p50_length": 0, "p90_length": 0, "p95_length": 0, "min_length": 0, "max_length": 0}
    assert {(r["scope"], r["value"]): r["documents"] for r in stored["rollup"]} == {("all", ""): 2, ("file_type", ".txt"): 1, ("file_type", ".pdf"): 1, ("failed_stage", "parse"): 1}
    rows = {r.doc_id: (r.chunks, r.leaf, r.sections) for r in spark.read.json(f"{tmp_path}/run/documents").collect()}
    assert rows == {"d": (3, 2, 2), "e": (1, 1, 0), "f": (0, 0, 1)}


def test_blocks_as_markdown_and_front_matter(spark):
    from granary.operators import blocks as B

    rows = [("d", 0, "title", "Head", None, 1), ("d", 3, "paragraph", "", None, 1), ("d", 5, "table", "| a |", "<table/>", None), ("d", 6, "list_item", "x", None, 2), ("d", 7, "table", "| b |", "", 2)]
    blocks = spark.createDataFrame(rows, "doc_id string, block_index int, block_type string, text string, html string, page_no int")
    made = B.blocks_to_markdown(blocks)
    body = "---\n\n## Page 1\n<!-- block_index=0 block_type=title -->\n## Head\n<!-- block_index=1 block_type=paragraph -->\n\n<!-- block_index=2 block_type=table -->\n<table/>\n\n---\n\n## Page 2\n<!-- block_index=3 block_type=list_item -->\n- x\n<!-- block_index=4 block_type=table -->\n| b |\n"
    assert made.first().markdown == body
    whole = B.with_audit_header(made, spark.createDataFrame([("d", "a/b: c.md")], "doc_id string, source_path string"))
    back = whole.select(B.front_matter(F.col("markdown")).alias("f")).first().f
    assert back.fields == {"doc_id": "d", "source_path": "a/b: c.md"} and back.body == "\n" + body
    texts = ["---\ntitle: \"A b\"\nempty:\ntitle: 'last'\nno pair\n---\nrest", "no header\n---\n", "---\nopen: x", "", "---\n\n---\nx"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(B.front_matter(F.col("t")).alias("f")).collect()]
    assert [(g.fields, g.body) for g in got] == [({"title": "last", "empty": ""}, "rest"), ({}, texts[1]), ({}, texts[2]), ({}, ""), ({}, "x")]

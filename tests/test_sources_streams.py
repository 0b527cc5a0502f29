"""File sources and streams, from files that the tests write."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import bm25
from granary.sources import files
from granary.streaming.jobs import IngestStore, parsed_chunks, stream_ingest

SF = "/root/testdata/sf0.001"


def test_read_corpus_and_sidecars(spark, tmp_path):
    for name in ("a.txt", "sub/b.PDF", "c.exe", "r.html"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "r.meta.json").write_text(json.dumps({"local_path": "x/r.html", "ticker": "T"}))
    (tmp_path / "gone.meta.json").write_text(json.dumps({"local_path": "x/gone.html"}))
    assert {(r.file_name, r.file_type, r.file_size) for r in files.read_corpus(spark, str(tmp_path)).collect()} == {("a.txt", ".txt", 5), ("b.PDF", ".pdf", 9), ("r.html", ".html", 6)}
    assert [(r.company, r.title) for r in files.read_report_sidecars(spark, str(tmp_path)).collect()] == [("T", "r.html")]


def test_read_questions_and_qrels(spark, tmp_path):
    rows = [{"id": "1", "question": " q ", "gold_files": "f", "gold_pages": [3, 4]}, {"question": "", "gold_files": "f"}, {"id": "2", "question": "x", "gold_files": ["a", " "], "gold_pages": 7}, {"question": "no files"}]
    (tmp_path / "q.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    assert [(r.id, r.question, r.gold_files, r.gold_pages) for r in files.read_questions(spark, f"{tmp_path}/q.jsonl").orderBy("id").collect()] == [("1", "q", ["f"], [3, 4]), ("2", "x", ["a"], [7])]
    (tmp_path / "q.tsv").write_text("query_id\tnode_id\trelevance\tqrel_role\n1\ta\t2\tprimary\n1\tb\t0\tsecondary\n1\tc\t1\tsecondary\n")
    assert {(r.evidence_id, *r.node_ids) for r in files.read_qrels(spark, f"{tmp_path}/q.tsv").collect()} == {("a", "a"), ("c", "c")}
    assert files.read_qrels(spark, f"{tmp_path}/q.tsv", "primary").count() == 1
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        files.read_qrels(spark, f"{tmp_path}/bad.tsv")


def test_audit_round_trip(spark):
    rows = [("d", 0, "One", "1-2", "text", "body\n\nmore"), ("d", 1, None, None, "table", "| a |\n\n---\n\n| b |"), ("e", 0, "T", "3", "text", "x")]
    schema = "doc_id string, section_index int, section_title string, page_range string, element_type string, text string"
    back = files.read_section_audit(files.sections_to_markdown(spark.createDataFrame(rows, schema)))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


INGEST = "source_path string, doc_id string, text string, deleted boolean"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_ingest_is_incremental_and_repeatable(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = IngestStore(spark, f"{tmp_path}/store", buckets=4)
    versions = [[("a", "a", "cat\ndog"), ("b", "b", "cat"), ("c", "c", "gone soon")], [("a", "a", "cat\nbird"), ("b", "b", "cat"), ("c", "c", None, True), ("d", "d", None, True)]]
    for i, rows in enumerate(versions):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("source_path", "doc_id", "text", "deleted"), r))) for r in rows))
        stream_ingest(spark.readStream.schema(INGEST).json(str(source)), store, f"{tmp_path}/cp").awaitTermination(120)
    chunks = rows_of(store.chunks().select("chunk_id", "doc_id", "text"))
    assert chunks == [("a:0", "a", "cat"), ("a:1", "a", "bird"), ("b:0", "b", "cat")]
    assert rows_of(store.statistics()[0]) == [("bird", 1), ("cat", 2)] and rows_of(store.statistics()[1]) == [(3, 3)]
    assert spark.read.parquet(f"{tmp_path}/store/chunks/part/version=1").count() == 2  # a batch writes its own rows only
    store.ingest(spark.createDataFrame([("z", "z", "late", False)], INGEST), 1)
    assert store.version() == 1 and rows_of(store.chunks().select("chunk_id", "doc_id", "text")) == chunks
    store.compact()
    assert rows_of(store.chunks().select("chunk_id", "doc_id", "text")) == chunks and rows_of(store.statistics()[0]) == [("bird", 1), ("cat", 2)]
    store.ingest(spark.createDataFrame([("b", "b", None, True), ("e", "e", "cat", None)], INGEST), 2)
    assert [r[0] for r in rows_of(store.chunks().select("chunk_id"))] == ["a:0", "a:1", "e:0"] and rows_of(store.statistics()[1]) == [(3, 3)]


def test_ingest_equals_a_batch_rebuild(spark, tmp_path):
    """Two versions of a folder through the log, with parsing, sections and chunks, equal the second one from scratch."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select(F.concat_ws("/", "source", "doc_id").alias("source_path"), F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("# Title\n\n"), "text").alias("text"), F.col("doc_id").alias("n"))
    store = IngestStore(spark, f"{tmp_path}/store", parsed_chunks)
    store.ingest(docs.where("n % 5 <> 4").drop("n"), 0)
    after = docs.withColumn("text", F.when(F.col("n") % 3 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))).withColumn("deleted", F.col("n") % 7 == 0)
    store.ingest(after.drop("n"), 1)
    want = parsed_chunks(after.where("not deleted").select("source_path", "doc_id", "text"))
    assert want.count() > 50 and rows_of(store.chunks()) == rows_of(want)
    index = bm25.build_index(want)
    frequencies, totals = store.statistics()
    assert rows_of(frequencies) == rows_of(index.frequencies) and rows_of(totals) == rows_of(index.totals)
    unchanged = spark.read.parquet(f"{tmp_path}/store/state/part/version=1").count()
    assert 0 < unchanged < 60


def test_ingest_folds_and_tidies_up(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    store = IngestStore(spark, f"{tmp_path}/store", buckets=2, fold_every=3)
    work = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path) / "granary"
    before = set(work.iterdir()) if work.exists() else set()
    for i in range(4):
        store.ingest(spark.createDataFrame([(f"p{i % 3}", f"p{i % 3}", f"word w{i}", None)], INGEST), i)
    assert [whole for _, whole in store._marks()] == [True, False]  # folded after the third
    assert rows_of(store.chunks().select("chunk_id", "text")) == [("p0:0", "word w3"), ("p1:0", "word w1"), ("p2:0", "word w2")]
    assert rows_of(store.statistics()[0]) == [("w1", 1), ("w2", 1), ("w3", 1), ("word", 3)]
    assert set(work.iterdir()) == before

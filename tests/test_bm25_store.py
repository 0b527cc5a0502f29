"""The stored index: changes equal a rebuild, readers open few buckets, a failed change leaves everything as it was."""

import math
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import bm25
from granary.operators.bm25_store import Bm25Store

CHUNKS = "chunk_id long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def same(spark, store, chunks):
    """The store's tables equal an index made from scratch."""
    want = bm25.build_index(chunks)
    assert rows_of(store.postings().select("token", "chunk_id", "tf")) == rows_of(want.postings.select("token", "chunk_id", "tf"))
    assert rows_of(store.postings().select("chunk_id", "token_len").distinct()) == rows_of(want.lengths)
    assert rows_of(store.frequencies().select("token", "df")) == rows_of(want.frequencies)
    assert rows_of(store.frequencies().select("token", "tf")) == rows_of(want.postings.groupBy("token").agg(F.sum("tf").alias("tf")))
    assert rows_of(store.totals()) == rows_of(want.totals.select("n", F.coalesce("sum_len", F.lit(0))))
    asked = spark.createDataFrame([(1, "cat dog zebra"), (2, "cat cat"), (3, "nothing known"), (4, None)], "query_id long, text string")
    rounded = lambda df: rows_of(df.select("query_id", "chunk_id", F.round("score", 9)))
    assert rounded(store.score(asked)) == rounded(bm25.score(want, asked))


def frame(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


def test_changes_equal_a_rebuild(spark, tmp_path):
    store = Bm25Store(spark, f"{tmp_path}/index", 4)
    first = [(1, "cat dog cat"), (2, "dog"), (3, None), (4, "  "), (5, "zebra cat"), (6, "bird " * 50)]
    store.apply(frame(spark, first))
    same(spark, store, frame(spark, first))
    kept = set(store._read("postings").inputFiles())
    store.apply(frame(spark, [(2, "dog dog bird"), (5, "?"), (7, "new cat")]), frame(spark, [(6, ""), (99, "")]).select("chunk_id"))
    second = [(1, "cat dog cat"), (2, "dog dog bird"), (7, "new cat")]
    same(spark, store, frame(spark, second))
    assert kept < set(store._read("postings").inputFiles())  # a change adds files and rewrites none
    store.apply(removed=frame(spark, [(7, ""), (2, "")]).select("chunk_id"))
    store.apply(frame(spark, [(7, "cat again"), (1, "cat dog cat")]))
    third = [(1, "cat dog cat"), (7, "cat again")]
    same(spark, store, frame(spark, third))
    store.compact()
    assert len(store.segments()) == 1
    same(spark, store, frame(spark, third))
    store.apply(frame(spark, [(8, "zebra")]))
    same(spark, store, frame(spark, [*third, (8, "zebra")]))


def test_readers_open_only_their_buckets(spark, tmp_path):
    store = Bm25Store(spark, f"{tmp_path}/index", 16)
    store.apply(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), id_col="doc_id")
    _, index = store.opened(spark.createDataFrame([(1, "contract")], "query_id long, text string"))
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan)
    files = [r.f for r in index.postings.select(F.input_file_name().alias("f")).distinct().collect()]
    assert {re.search(r"bucket=(\d+)", f)[1] for f in files} == {str(spark.range(1).select(store.bucket(F.lit("contract")).alias("b")).first().b)}
    assert len({re.search(r"bucket=(\d+)", f)[1] for f in store.postings().inputFiles()}) == 16
    tokens = [r.token for r in spark.read.parquet(files[0]).select("token").collect()]
    assert tokens == sorted(tokens)


def test_a_failed_change_leaves_the_index(spark, tmp_path, monkeypatch):
    store = Bm25Store(spark, f"{tmp_path}/index", 4)
    store.apply(frame(spark, [(1, "cat dog")]))
    broken = frame(spark, [(2, "dog")]).withColumn("text", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.apply(broken)
    real = Bm25Store.totals
    monkeypatch.setattr(Bm25Store, "change", lambda self, *a: (self.postings(), self.postings().select("chunk_id"), self.frequencies(), real(self).select(F.raise_error(F.lit("lost")))))
    with pytest.raises(Exception, match="lost"):  # after postings have been written
        store.apply(frame(spark, [(3, "dog")]))
    monkeypatch.undo()
    same(spark, store, frame(spark, [(1, "cat dog")]))
    store.apply(frame(spark, [(2, "dog")]))
    same(spark, store, frame(spark, [(1, "cat dog"), (2, "dog")]))


def test_empty_corpus(spark, tmp_path):
    store = Bm25Store(spark, f"{tmp_path}/index", 4)
    store.apply(frame(spark, []))
    assert store.postings().count() == 0 and rows_of(store.totals()) == [(0, 0)]
    assert store.score(spark.createDataFrame([(1, "cat")], "query_id long, text string")).count() == 0


@pytest.mark.parametrize("block, chunks, postings", [(2_000_000, 256, 8192), (40, 3, 5)])
def test_no_row_of_a_pair_is_shuffled(spark, tmp_path, monkeypatch, block, chunks, postings):
    for name, value in (("BLOCK_ROWS", block), ("QUERY_BLOCK", chunks), ("CHUNK_SLICE", chunks), ("POSTING_SLICE", postings)):
        monkeypatch.setattr(bm25, name, value)
    words = "ant bee cat dog elk fox gnu hen".split()
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 2 + i % 7))) for i in range(120)] + [(500 + i, "bee cat") for i in range(30)]
    queries = spark.createDataFrame([(i, f"{words[i % 8]} {words[i * 3 % 8]} cat unknown") for i in range(20)], "query_id long, text string")
    store = Bm25Store(spark, f"{tmp_path}/index", 4)
    store.apply(frame(spark, rows))
    freq, totals = {r.token: r.df for r in store.frequencies().collect()}, store.totals().first()
    texts, want = {i: t.split() for i, t in rows}, {}
    for q, text in queries.collect():
        for i, own in texts.items():
            s = sum(math.log(1 + (totals.n - freq[w] + 0.5) / (freq[w] + 0.5)) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / (totals.sum_len / totals.n))) for w in text.split() if w in own)
            if s > 0:
                want.setdefault(q, []).append((-round(s, 9), i))
    every = store.score(queries)
    assert "hashpartitioning(query_id" not in every._jdf.queryExecution().executedPlan().toString()
    assert rows_of(every.select("query_id", "chunk_id", F.round("score", 6))) == sorted((q, i, round(-s, 6)) for q, found in want.items() for s, i in found)
    few = store.score(queries, k=4)
    assert few.count() < every.count()
    top = bm25.top_k(few, 4, F.desc(F.round("score", 9)))
    assert rows_of(top.select("query_id", "rank", "chunk_id")) == sorted((q, n + 1, i) for q, found in want.items() for n, (_, i) in enumerate(sorted(found)[:4]))
    named = bm25.top_k(store.score(queries, chunk_name=F.concat(F.lit("c"), F.col("chunk_id").cast("string")), k=4), 4, F.desc(F.round("score", 9)))
    assert rows_of(named.select("query_id", "rank", "chunk_id")) == sorted((q, n + 1, c) for q, found in want.items() for n, (_, c) in enumerate(sorted((s, f"c{i}") for s, i in found)[:4]))


def test_counts_without_postings_equal_the_index(spark, monkeypatch):
    """Repeated ids, texts without a token and null texts count as in build_index, and no postings are written."""
    rows = spark.createDataFrame([("a", "x y x"), ("a", "y z"), ("b", "x"), ("c", " "), ("d", None), ("e", "Z z")], "chunk_id string, text string")
    index, names = bm25.build_index(rows), []
    want = [sorted(index.frequencies.collect()), index.totals.collect()]
    real = bm25.written
    monkeypatch.setattr(bm25, "written", lambda df, name: (names.append(name), real(df, name))[1])
    frequencies, totals = bm25.counts(rows)
    assert [sorted(frequencies.collect()), totals.collect()] == want and names == ["bm25-repeated"]


def test_a_delta_of_counts_makes_no_postings(spark, monkeypatch):
    """The query's counts after a change are those of a rebuild, and no index is stored for them."""
    from granary.plans import all_queries, retrieval

    monkeypatch.setattr(retrieval, "store_of", lambda t: pytest.fail("an index was built"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" fresh token"))).otherwise(F.col("text"))
    want = bm25.build_index(docs.withColumn("text", text), "doc_id")
    got = all_queries()["bm25_apply_delta"](spark, "/root/testdata/sf0.001")
    assert rows_of(got) == rows_of(want.frequencies.crossJoin(want.totals))

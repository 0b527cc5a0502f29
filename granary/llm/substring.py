"""Substring dedup by relative Lempel-Ziv factors against an index of earlier documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import discard, documents, gram_hashes, map_batches, materialise, mixed, text_rows, word_hashes

#: Words of a k-gram that can mark a window.
MARK = 5


def window_marks(hashes: np.ndarray, window: int) -> np.ndarray:
    """Of every window, the smallest hash of its MARK-word runs: equal windows have equal marks, and neighbours
    mostly share theirs, so a text has about one mark for each five words."""
    grams = gram_hashes(hashes, min(MARK, window), 1)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for i in range(1, window - min(MARK, window) + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def mark_runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of windows with one mark."""
    first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(marks)))


def factors(found: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, end, reference document, its first word) from runs of windows that occur earlier
    (first window, number, reference document, its first window), in order.

    A factor goes on while the next run is found right behind the last one in the same reference block. Where the
    reference changes, the windows that straddle the boundary were looked up too, and begin the next factor; factors
    may thus overlap by up to window - 1 words, and every found window lies in one."""
    out: list[list[int]] = []
    for at, n, ref, ref_at in found:
        if out and out[-1][1] == at and out[-1][2] == ref and out[-1][3] + at - out[-1][0] == ref_at:
            out[-1][1] = at + n
        else:
            out.append([at, at + n, ref, ref_at])
    return [(a, b + window - 1, r, s) for a, b, r, s in out]


def duplicate_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text and spans, an array of
    (first_word, end_word, ref_doc_id, ref_first_word).

    Every document is parsed against the index of all windows' first occurrences (the reference, in blocks of one
    document each): spans are its factors of at least `window` words that occur in a document of smaller doc_id, and
    their words are removed. The index is built in three steps, each on what the last one left open:

    1. Each window has a mark. Marks of a single document settle most windows.
    2. Neighbouring windows of one mark are a run. A run that a smaller document has word for word is found whole, so
       copies of a passage count as one class, however many there are.
    3. Where a mark has several classes, their first documents' windows are looked up one by one.

    Marks, classes and windows are aggregated before they are shuffled, hot ones sit on the split side of joins with
    one row a key on the other, and nothing is gathered but a document's own marks and found runs. Marks, runs and
    windows are compared by 64-bit hashes, runs within an equal mark and length, windows within an equal mark.

    Null text has no words. Rows with a null doc_id keep all words and are no reference. Rows of one doc_id are no
    reference for each other. Texts shorter than the window keep all words. An empty table gives an empty result."""
    rows = text_rows(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text"))  # tells rows of one doc_id apart
    kind = docs.schema[id_col].dataType.simpleString()

    def mark_maker():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.unique(window_marks(word_hashes(t.encode().split()), window)) for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            marks = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(marks)], ["doc_id", "mark"])

        return step

    known = rows.where("text is not null and doc_id is not null").select("doc_id", "text")
    marks = materialise(map_batches(known, mark_maker, f"doc_id {kind}, mark long"), "marks")
    shared = marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mark")
    own = materialise(marks.join(shared, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks")), "shared-marks")
    discard(marks)

    def run_maker():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, (text, known) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3))):
                hashes = word_hashes((text or "").encode().split())
                marks = window_marks(hashes, window)
                first, n = mark_runs(marks)
                open_runs = np.isin(marks[first].view(np.int64), known.values.to_numpy())
                first, n = first[open_runs], n[open_runs]
                if not len(first):
                    continue
                each = gram_hashes(hashes, window, 2)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = each[np.repeat(first, n) + inside]
                total = np.add.reduceat(each * (mixed(inside.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), np.cumsum(n) - n)
                for part, values in zip(out, (np.full(len(first), i), marks[first].view(np.int64), mixed(total).view(np.int64), first, n, each.view(np.int64))):
                    part.append(values)
            owner, mark, total, first, n, each = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(each))
            owner = pa.array(owner)
            return pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(2).take(owner), pa.array(mark), pa.array(total), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), lists], ["doc_id", "row_hash", "mark", "run", "at", "n", "windows"])

        return step

    open_rows = rows.join(own, "doc_id").select("doc_id", "text", "row_hash", "marks")
    runs = materialise(map_batches(open_rows, run_maker, f"doc_id {kind}, row_hash long, mark long, run long, at int, n int, windows array<long>"), "runs")
    discard(own)
    key = ["mark", "run", "n"]
    classes = runs.groupBy(*key).agg(F.min("doc_id").alias("ref"), F.min_by("at", F.col("doc_id")).alias("ref_at"))
    classes = materialise(classes, "run-classes")
    whole = runs.drop("windows").join(classes, key).where("ref < doc_id").select("doc_id", "row_hash", "at", "n", "ref", "ref_at")
    several = classes.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark")
    left = classes.join(several, "mark", "left_semi").select(*key, F.col("ref").alias("doc_id"))
    single = runs.join(left, [*key, "doc_id"]).select("doc_id", "row_hash", "mark", "at", F.posexplode("windows").alias("i", "h"))
    single = materialise(single.select("doc_id", "row_hash", "mark", "h", (F.col("at") + F.col("i")).alias("at")), "windows")
    first = single.groupBy("mark", "h").agg(F.min("doc_id").alias("ref"), F.min_by("at", F.col("doc_id")).alias("ref_at"), F.max("doc_id").alias("last")).where("ref < last").drop("last")
    parts = single.join(first, ["mark", "h"]).where("ref < doc_id").select("doc_id", "row_hash", "at", F.lit(1).alias("n"), "ref", "ref_at")
    found = whole.unionByName(parts).groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set(F.struct("at", "n", "ref", "ref_at"))).alias("found"))
    found = materialise(found, "found-runs")

    def cut_maker():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, kept, spans = [], [], [], []
            for text, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                n.append(len(words))
                own = factors([(h["at"], h["n"], h["ref"], h["ref_at"]) for h in hits or []], window)
                rest, at = [], 0
                for a, b, _, _ in own:
                    rest += words[at:a] if a > at else []
                    at = max(at, b)
                rest += words[at:]
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest).decode())
                spans.append([{"first_word": a, "end_word": b, "ref_doc_id": r, "ref_first_word": s} for a, b, r, s in own])
            ids = batch.schema.field(0).type
            shape = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("ref_doc_id", ids), ("ref_first_word", pa.int32())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, shape)], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

        return step

    cut = rows.join(found, ["doc_id", "row_hash"], "left").select("doc_id", "text", "found")
    return map_batches(cut, cut_maker, f"doc_id {kind}, n_words long, n_removed long, kept_text string, spans array<struct<first_word:int,end_word:int,ref_doc_id:{kind},ref_first_word:int>>")


def op6_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with w as (select doc_id, string_split_regex(body, '[\x20\x09-\x0D]+') as ws
  from (select doc_id, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as body from documents) where body <> ''),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
first as (select g, min(doc_id) as m from win group by g),
hit as (select doc_id, i from win join first using (g) where m < doc_id),
covered as (select distinct doc_id, i + d as p from hit, (select unnest(range(0, 13)) as d)),
word as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
done as (select word.doc_id, count(*) as n_words, count(covered.p) as n_removed, coalesce(string_agg(case when covered.p is null then x end, ' ' order by word.p), '') as kept
  from word left join covered on covered.doc_id = word.doc_id and covered.p = word.p group by word.doc_id)
select documents.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join done using (doc_id)
"""

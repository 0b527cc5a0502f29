"""Cross-entropy difference between matched n-gram models of a target and of the background corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import discard, documents, if_small, map_batches, materialise, mixed, multipliers, text_rows, word_hashes

#: What every word's count is raised by, and how many occurrences a context's back-off to single words weighs as.
ADDED, BACKOFF = 0.5, 8.0
#: Parts of words and bigrams that are counted and joined one after the other, which bounds the disk that shuffles take.
PARTS = 4
#: The context of a text's first word, among words' hashes.
BEGIN = np.uint64(0)


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def bigram_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with the one before it."""
    a, b = multipliers(2, 8)
    return mixed(before * a + words * b)


def _sequences(rows: DataFrame) -> DataFrame:
    """(doc_id, n_words, words) of rows (doc_id, text): the words' hashes in order, eight
    bytes each."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [word_hashes(text_words(t)).tobytes() for t in batch.column(1).to_pylist()]
            sizes = [len(f) // 8 for f in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "words"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, n_words long, words binary")


def _summed(keys: list[np.ndarray], values: list[np.ndarray], also: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The distinct tuples of keys, what stands beside their first, and the sums of values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.logical_or.reduce([np.concatenate([np.ones(min(1, len(order)), bool), k[1:] != k[:-1]]) for k in keys]))
    return [*(k[first] for k in keys), *(x[order[first]] for x in also or []), *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def _expanded(own: DataFrame, part: int, names: list[str], take: Callable) -> DataFrame:
    """take(rows, words, befores, is_context) of some texts at a time as a table: for each word of theirs the row, its
    hash, the hash before it, and whether another word follows; texts' first contexts come as words of hash BEGIN."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, names_of_rows = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.array([len(x) // 8 for x in found], np.int64)
            words = np.frombuffer(b"".join(found), np.uint64)
            rows = np.repeat(np.arange(len(found), dtype=np.uint16), sizes)  # short numbers are sorted in one pass
            ends = np.cumsum(sizes)
            starts = (ends - sizes)[sizes > 0]
            before = np.concatenate([[BEGIN], words[:-1]]).astype(np.uint64)[: len(words)]
            before[starts] = BEGIN
            follows = np.ones(len(words), np.int64)
            follows[ends[sizes > 0] - 1] = 0
            columns = take(rows, words, before, follows, starts, part)
            if names[0] == "row":
                columns[0] = names_of_rows[columns[0]]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

        return step

    return map_batches(own.select("row", "words"), make, ", ".join(f"{n} long" for n in names))


def _with_begins(rows: np.ndarray, words: np.ndarray, follows: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Rows, words, occurrences and occurrences as a context, the contexts of first words included."""
    n = len(starts)
    return [np.concatenate(x) for x in ((rows, rows[starts]), (words, np.full(n, BEGIN)), (np.ones(len(words), np.int64), np.zeros(n, np.int64)), (follows, np.ones(n, np.int64)))]


def _words_of_rows(rows, words, before, follows, starts, part) -> list[np.ndarray]:
    rows, words, n, context = _with_begins(rows, words, follows, starts)
    own = words & np.uint64(PARTS - 1) == part
    return _summed([rows[own], words[own]], [n[own], context[own]])


def _words(rows, words, before, follows, starts, part) -> list[np.ndarray]:
    _, words, n, context = _with_begins(rows, words, follows, starts)
    return _summed([words], [n, context])


def _grams_of_rows(rows, words, before, follows, starts, part) -> list[np.ndarray]:
    own = words & np.uint64(PARTS - 1) == part
    return _summed([rows[own], bigram_hashes(before[own], words[own])], [np.ones(own.sum(), np.int64)])


def _grams(rows, words, before, follows, starts, part) -> list[np.ndarray]:
    own = words & np.uint64(PARTS - 1) == part
    return _summed([bigram_hashes(before[own], words[own])], [np.ones(own.sum(), np.int64)], [words[own]])


def _two_sides(target: DataFrame, background: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Sums of the counts of either side, as t_count and b_count."""
    side = lambda df, own, other: df.select(*keys, *(F.col(c).alias(f"{own}_{c}") for c in counts), *(F.lit(0).cast("long").alias(f"{other}_{c}") for c in counts))
    both = side(target, "t", "b").unionByName(side(background, "b", "t"))
    return both.groupBy(keys[0]).agg(*(F.first(k).alias(k) for k in keys[1:]), *(F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in "tb" for c in counts))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", background_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, target_loss, background_loss (mean nats a word) and difference, the
    mean over words of target loss minus background loss: the lower, the more like the target. The background is docs
    themselves unless it is given.

    Both models give a word's probability after the word before it (a text's first word follows a beginning of its own),
    over one vocabulary, the V words of either side and an unknown one, and are smoothed alike. A word of c occurrences
    among n has P(w) = (c + ADDED) / (n + ADDED * (V + 1)). After a context u of c(u) occurrences, c(u, w) of which go on
    with w, it has (c(u, w) + BACKOFF * P(w)) / (c(u) + BACKOFF): bigrams interpolated with single words, the less the
    commoner the context. Probabilities after a context add up to 1.

    All words and bigrams of all texts count, however rare. Counts stay in Spark tables: a text's loss is a sum over
    its distinct words (the back-off and the contexts) and over its bigrams with a row of counts (what those add), so it
    meets words and bigrams in one join each, part by part: a part has the words whose hashes end alike and the bigrams
    that end with them, so its words are broadcast where they are few enough. Counts are partial sums before they are shuffled, and a hot
    word or bigram is one row of the small side of a join. Where docs are the background, words and bigrams that only
    occur once, and not in the target, are known by their absence: bigrams are not stored, words not joined.

    Null, empty and wordless texts have 0 words and null losses. Whole texts are scored; repeated rows and null ids
    give a row each, an empty table none. Two empty sides know the unknown word only. Other columns are not read."""
    make = lambda df, i, t, name: materialise(_sequences(text_rows(df, i, t)).withColumn("row", F.monotonically_increasing_id()), name)
    own = make(docs, id_col, text_col, "lm-words")
    wanted = make(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id", "text", "lm-target")
    whole = own if background is None else make(background.select(F.lit(0).alias("id"), F.col(background_col).alias("text")), "id", "text", "lm-background")
    once = int(background is None)  # times that a document's bigram without a row of counts occurs in the background
    counted = lambda df: _expanded(df, 0, ["word", "n", "context"], _words)
    words = materialise(_two_sides(counted(wanted), counted(whole), ["word"], ["n", "context"]), "lm-counts")
    # the beginning is no word: it has contexts only
    total = words.agg(F.coalesce(F.sum("t_n"), F.lit(0)).alias("t"), F.coalesce(F.sum("b_n"), F.lit(0)).alias("b"), F.count_if(F.col("t_n") + F.col("b_n") > 0).alias("v")).first()
    least = {"t": 0, "b": once}
    backoff = lambda s: BACKOFF * (F.coalesce(f"{s}_n", F.lit(least[s])) + ADDED) / (total[s] + ADDED * (total.v + 1))
    contexts = lambda s: F.coalesce(f"{s}_context", least[s] * F.col("context"))  # a word without a row of counts occurs in its document only
    sums = []
    for p in range(PARTS):
        small = words.where(F.col("word").bitwiseAND(F.lit(PARTS - 1)) == p)
        small = if_small(materialise(small.where("b_n <> 1 or t_n + t_context > 0") if once else small, "lm-words-part"))
        met = _expanded(own, p, ["row", "word", "n", "context"], _words_of_rows).join(small, "word", "left")
        part = lambda s: F.sum(F.col("n") * F.log(least[s] + backoff(s)) - F.col("context") * F.log(contexts(s) + BACKOFF)).alias(s)
        sums.append(materialise(met.groupBy("row").agg(part("t"), part("b")), "lm-word-sums"))
        grams = lambda df: _expanded(df, p, ["gram", "word", "n"], _grams)  # noqa: B023, E731
        counts = _two_sides(grams(wanted), grams(whole), ["gram", "word"], ["n"]).where((F.col("t_n") > 0) | (F.col("b_n") > once))
        counts = counts.select("gram", "word", F.col("t_n").alias("t_both"), F.col("b_n").alias("b_both")).join(small, "word")
        more = lambda s: (F.log(F.col(f"{s}_both") + backoff(s)) - F.log(least[s] + backoff(s))).alias(s)
        counts = materialise(counts.select("gram", more("t"), more("b")), "lm-bigrams")
        met = _expanded(own, p, ["row", "gram", "n"], _grams_of_rows).join(counts.hint("shuffle_hash"), "gram")
        sums.append(materialise(met.groupBy("row").agg(*(F.sum(F.col("n") * F.col(s)).alias(s) for s in "tb")), "lm-bigram-sums"))
        discard(counts)
    sums = reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    loss = lambda s: -F.col(s) / F.nullif("n_words", F.lit(0))
    scored = own.select("doc_id", "row", "n_words").join(sums, "row", "left").select("doc_id", "n_words", loss("t").alias("target_loss"), loss("b").alias("background_loss"))
    return scored.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the benchmark's text, the background all documents; every document is scored."""
    return cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

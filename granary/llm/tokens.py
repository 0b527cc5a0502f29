"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches, materialise, shared_dir, spans_of, text_rows

CACHE = "text_digest string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file: counts of another version are never taken."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: Fixed value: the pattern by which a byte-level tokenizer splits text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters than these go to the library whole: versions of Unicode differ in what they call a letter.
PLAIN = re.compile(r"[\x00-\x1b\x20-\u052f\u2000-\u206f]*")
#: Pieces whose counts a worker remembers, and characters it splits at a time.
REMEMBERED, CHARS = 200_000, 1 << 19


def piecewise(path: str) -> bool:
    """Whether the tokenizer merges within pieces of BYTE_LEVEL and does nothing else to a text."""
    with open(path) as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    return not told.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the library of the file's kind: tokenizers (.json) or sentencepiece (.model).

    Where a tokenizer merges within pieces only, a text's count is the sum of its pieces' counts: the library encodes
    each distinct piece once. Texts that hold an added token's string, or characters beyond PLAIN, are encoded whole."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    split, added, known = regex.compile(BYTE_LEVEL).findall, [t.content for t in tokenizer.get_added_tokens_decoder().values()], {}

    def library(texts: list[str]) -> list[int]:
        """Few at a time, as the library holds every token's fields."""
        return [len(x) for at in range(0, len(texts), 64) for x in tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]

    def by_piece(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t) and not any(a in t for a in added)]
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, n in zip(rest, library([texts[i] for i in rest])):
            out[i] = n
        for a, b in spans_of([len(texts[i]) for i in plain], CHARS):
            pieces = [split(texts[i]) for i in plain[a:b]]
            new = list(set().union(*pieces).difference(known))
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set().union(*pieces))
            known.update(zip(new, library(new)))
            for i, p in zip(plain[a:b], pieces):
                out[i] = sum(map(known.__getitem__, p))
        return out

    return by_piece if piecewise(path) else library


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache table; empty where none was written yet. Where a digest was appended twice, the counts are equal."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens. Null text counts as empty; the whole text is encoded.

    Contents are joined by SHA-256 with the counts that the cache holds for this tokenizer's digest. Of each content
    that it misses, one row is chosen on digests alone; only those rows' texts are encoded, and the counts are
    appended to the cache before they are joined back. The choice is narrow and pre-aggregated, so a text in a third
    of all rows costs one encoding and a split join. Content is not altered before hashing, as any change could
    change its tokens. tokenizer and cache are paths; workers read the former, the latter must be shared. A null or
    repeated doc_id is counted like any other row."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    rows = text_rows(docs, id_col, text_col).select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_digest"))
    narrow = materialise(rows.select("doc_id", "text_digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    held = read_cache(spark, cache).where(F.col("tokenizer") == version)
    misses = narrow.groupBy("text_digest").agg(F.min("doc_id").alias("doc_id")).join(held, "text_digest", "left_anti")
    a, b = rows.alias("a"), misses.alias("b")
    texts = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_digest") == F.col("b.text_digest")), "left_semi").select("text_digest", "text")

    def make():
        counts = encoder(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = counts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["text_digest", "tokenizer", "n_tokens"])

        return step

    map_batches(texts, make, CACHE).write.mode("append").parquet(cache)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return narrow.join(known, "text_digest").select("doc_id", "n_bytes", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every document, from a cache that starts empty, so that the query does all its work each time."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/granary/token-counts-{uuid.uuid4().hex}"
    found = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))

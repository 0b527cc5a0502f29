"""Exact dedup by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import SPACE, documents, if_small, materialise, text_rows


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the length of their normalised text; rows of a length of their own are settled. The others
    are grouped by length and prefix hash, and again the single ones are settled. Only rows of a (length, prefix)
    group that is left have their whole text hashed (SHA-256), and equal hashes make the groups of copies. Counts are
    partial sums before any shuffle; joins have one row a key on their small side, so Spark can split a hot group.

    text_sha256 is null for rows settled without it, unless digest_all asks for everyone's: it is then computed where
    the text is scanned, and no text is shuffled. keep_id is the smallest doc_id of equal texts, kept is true where
    it is the row's own. Null text counts as empty. A null doc_id never wins over another; rows that repeat a doc_id
    along with its text are that document again, and are all kept if it is. An empty table gives an empty result."""
    body = normalised(F.col(text_col))
    rows = text_rows(docs, id_col, text_col).select("doc_id", body.alias("body"))
    sized = [F.length("body").alias("n"), F.xxhash64(F.substring("body", 1, prefix_chars)).alias("head")]
    if digest_all:
        rows = materialise(rows.select("doc_id", *sized, F.sha2("body", 256).alias("full")), "exact-digests")
        keys, full = rows.select("n", "head"), F.col("full")
    else:
        rows = rows.select("doc_id", *sized, "body")
        keys, full = materialise(rows.select("n", "head"), "exact-sizes"), F.when(F.col("open"), F.sha2("body", 256))
    lengths = keys.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n")
    heads = keys.join(lengths, "n", "left_semi").groupBy("n", "head").agg(F.count("*").alias("c")).where("c > 1").select("n", "head", F.lit(True).alias("open"))
    heads = if_small(materialise(heads, "exact-heads"))  # so that bodies are shuffled only where very many are open
    hashed = materialise(rows.join(heads, ["n", "head"], "left").select("doc_id", "open", full.alias("full")), "exact-hashed")
    groups = hashed.where("open").groupBy("full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(F.concat(F.lit("hash "), "full").alias("key"), "keep_id", "group_size")
    # rows without a hash get a key of their own kind, so that they neither match nor meet in one task
    out = hashed.withColumn("key", F.coalesce(F.concat(F.lit("hash "), "full"), F.concat(F.lit("id "), F.col("doc_id").cast("string")))).join(groups, "key", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("full").alias("text_sha256"))


def op2_exact_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), digest_all=True)


OP2_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id,
       min(doc_id) over (partition by body) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept,
       sha256(body) as text_sha256
from n
"""

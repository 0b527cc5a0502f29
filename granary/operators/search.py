"""Lexical, vector and fused search of one query set, with context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.tables import written
from granary.operators import bm25, dense, fusion


def candidate_lists(queries: DataFrame, scored: DataFrame, vectors: DataFrame, candidate_k: int = 20) -> dict[str, DataFrame]:
    """(query_id, chunk_id, score, rank) by strategy: bm25, dense, and their reciprocal rank fusion. Queries have a text
    and an embedding each, scored has their lexical scores; both lists are computed and written once."""
    lexical = written(bm25.top_k(scored, candidate_k, F.desc(F.round("score", 9))), "bm25-list")
    near = written(dense.dense_topk(queries, vectors, candidate_k), "dense-list")
    return {"bm25": lexical, "dense": near, "hybrid": fusion.rrf_fuse([lexical, near], candidate_k)}


def hybrid_search(queries: DataFrame, scored: DataFrame, vectors: DataFrame, chunks: DataFrame, candidate_k: int = 20, final_k: int = 10) -> DataFrame:
    """(strategy, query_id, rank, chunk_id, text, score, auto_merged, retrieval_mode): of each strategy's candidates,
    leaves of a parent merged and tables completed, the first final_k.

    Chunk rows are read for what was found only; strategies go through the context steps side by side."""
    lists = candidate_lists(queries, scored, vectors, candidate_k)
    one = lambda name, df: df.select(F.to_json(F.struct(F.lit(name).alias("s"), F.col("query_id").cast("string").alias("q"))).alias("query_id"), "rank", "chunk_id", "score")
    found = reduce(DataFrame.unionByName, (one(name, df) for name, df in lists.items()))
    hits = written(found.join(chunks.drop("score"), "chunk_id"), "search-hits")
    merged = fusion.auto_merge(hits, chunks)
    placed = written(merged.join(chunks.select("chunk_id", "doc_id", "table_id"), "chunk_id"), "search-merged")
    rows = fusion.expand_table_context(placed, chunks).join(placed.select("query_id", "rank", "auto_merged"), ["query_id", "rank"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= final_k)
    name = F.from_json("query_id", "s string, q string")
    return rows.select(name["s"].alias("strategy"), name["q"].alias("query_id"), "rank", "chunk_id", "text", "score", "auto_merged", "retrieval_mode")

"""Nearest neighbours of a query table in a vector table, by blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.tables import written
from granary.operators.bm25 import top_k

#: Query vectors and rows that are multiplied at a time, and digits of a score that count.
QUERY_BLOCK, ROW_SLICE, DIGITS = 1024, 1024, 9


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, query_col: str = "query_id", id_col: str = "chunk_id", vector_col: str = "embedding", block_queries: int = 50_000) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k vectors of largest cosine similarity to each query.

    Queries go through in blocks of about block_queries, dealt by hash: a block is broadcast, every ROW_SLICE vectors are
    multiplied with QUERY_BLOCK of it at a time, each task keeps a running top k of each query, and only those rows are
    shuffled.
    Scores are compared at nine digits; ties go by chunk_id, so one very common vector takes no more rows than others.
    Rows with a null or zero vector match nothing."""
    asked = queries.select(F.col(query_col).alias("q"), F.col(vector_col).alias("v")).where("v is not null")
    blocks = max(1, math.ceil(asked.count() / block_queries))
    part = lambda i: asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_col), (vectors, id_col))]
    rows = vectors.select(F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("v")).where("v is not null")
    found = [_best(part(i), rows, k, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double") for i in range(blocks)]
    if blocks > 1:  # each block's rows are cut to k and written before the next block is held
        found = [written(top_k(x, k, F.desc(F.round("score", DIGITS))).drop("rank"), "dense-block") for x in found]
    return top_k(reduce(DataFrame.unionByName, found), k, F.desc(F.round("score", DIGITS)))


def _best(asked: DataFrame, rows: DataFrame, k: int, schema: str) -> DataFrame:
    """Each task's k best rows of each query of a block."""
    held = asked.toPandas()
    matrix = np.array(held["v"].tolist(), np.float64).reshape(len(held), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = rows.sparkSession.sparkContext.broadcast((held["q"].to_numpy(), matrix / np.where(norms > 0, norms, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by block: query number, id, score
        kind = None
        for batch in (b.slice(at, ROW_SLICE) for b in batches for at in range(0, b.num_rows, ROW_SLICE)):
            if not len(q):
                continue
            kind = batch.column(0).type
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            live = np.flatnonzero(size[:, 0] > 0)
            if not len(live):
                continue
            x, ids = x[live] / size[live], batch.column(0).take(pa.array(live)).to_numpy(zero_copy_only=False)
            for at in range(0, len(q), QUERY_BLOCK):
                scores = np.round(q[at : at + QUERY_BLOCK] @ x.T, DIGITS)
                least = np.partition(scores, -min(k, len(live)), axis=1)[:, -min(k, len(live))]
                row, best = np.nonzero(scores >= least[:, None])
                new = at + row, ids[best], scores[row, best]
                if at in kept:
                    new = tuple(map(np.concatenate, zip(kept[at], new)))
                order = np.lexsort((new[1], -new[2], new[0]))
                new = tuple(c[order] for c in new)
                place = np.arange(len(order)) - np.searchsorted(new[0], new[0])
                kept[at] = tuple(c[place < k] for c in new)
        for number, ids, scores in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(names[number]), pa.array(ids, kind), pa.array(scores)], ["query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, schema)

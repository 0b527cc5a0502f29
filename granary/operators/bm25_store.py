"""A BM25 index in a folder: postings in token buckets, extended by segments, opened by the buckets a query set needs."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.tables import if_small, written
from granary.functions.text import bm25_tokens
from granary.operators.bm25 import Bm25Index, asked_tokens, score_asked


class Bm25Store:
    """postings(token, chunk_id, tf, token_len), frequencies(token, df, tf) and totals(n, sum_len), a folder a segment.

    A segment holds what one change adds, and the ids that it takes away; postings of an id count until a later segment
    names it. Frequencies and totals are signed, so they are summed, not recounted. Postings and frequencies lie in
    buckets by token, sorted by it: a reader opens the buckets of its tokens, and inside a file Parquet's statistics
    skip what lies between. A segment counts once its mark is written, so a failed change leaves the index as it was.
    Buckets with a very frequent token are split over several files as they are written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _marks(self) -> list:
        try:
            return sorted(self.spark.read.schema("number long, name string, first long, kind string").parquet(f"{self.path}/marks").collect())  # a row a change
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def segments(self) -> list[str]:
        """The names of the segments that count, in order."""
        marks = self._marks()
        first = max((r["first"] for r in marks), default=0)  # a compacted segment stands for all before it
        return [r.name for r in marks if r.number >= first]

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all segments, with the segment's place as `segment`."""
        parts, kind = [], next((r.kind for r in self._marks()), "string")
        schema = {"postings": f"token string, chunk_id {kind}, tf long, token_len long, bucket int", "frequencies": "token string, df long, tf long, bucket int", "removed": f"chunk_id {kind}", "totals": "n long, sum_len long"}[table]
        for place, name in enumerate(self.segments()):
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{name}").withColumn("segment", F.lit(place))
            parts.append(rows if buckets is None else rows.where(F.col("bucket").isin(buckets)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """Postings of the chunks that are there now."""
        rows = self._read("postings", buckets)
        if len(self.segments()) > 1:
            gone = if_small(written(self._read("removed").groupBy("chunk_id").agg(F.max("segment").alias("until")), "bm25-gone"))
            rows = rows.join(gone, "chunk_id", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until")))
        return rows.select("token", "chunk_id", "tf", "token_len")

    def frequencies(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("frequencies", buckets)
        return rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("df > 0")

    def totals(self) -> DataFrame:
        return self._read("totals").agg(F.sum("n").alias("n"), F.sum("sum_len").alias("sum_len"))

    def index(self, buckets: list[int] | None = None) -> Bm25Index:
        """What scoring reads, of some buckets or of all. Lengths come with the postings."""
        return Bm25Index(self.postings(buckets), None, self.frequencies(buckets), self.totals())

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(postings, ids that go, frequencies, totals) of a change: `added` chunks and the ids of `removed` ones.

        An added chunk replaces one of its id. What goes is looked up in the stored postings, so only the added texts
        are tokenised, once. Chunks without a token are left out."""
        fresh = gone = None
        if added is not None:
            tokens = bm25_tokens(F.col(text_col))
            rows = written(added.select(F.col(id_col).alias("chunk_id"), tokens.alias("tokens")).where(F.size("tokens") > 0), "bm25-tokens")
            fresh = rows.select("chunk_id", F.size("tokens").cast("long").alias("token_len"), F.explode("tokens").alias("token")).groupBy("token", "chunk_id", "token_len").agg(F.count("*").alias("tf"))
            fresh = written(fresh.select("token", "chunk_id", "tf", "token_len"), "bm25-fresh")
        ids = [df.select(F.col(id_col).alias("chunk_id")) for df in (added, removed) if df is not None]
        names = reduce(DataFrame.unionByName, ids).distinct()
        if self.segments():
            names = if_small(written(names, "bm25-names"))
            gone = written(self.postings().join(names, "chunk_id", "left_semi"), "bm25-removed")
            names = gone.select("chunk_id").distinct()
        else:
            names = names.limit(0)
        signed = lambda df, sign: df.select("token", "chunk_id", "token_len", F.lit(sign).alias("sign"), "tf")
        both = reduce(DataFrame.unionByName, [signed(df, sign) for df, sign in ((fresh, 1), (gone, -1)) if df is not None])
        frequencies = both.groupBy("token").agg(F.sum("sign").cast("long").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("tf")).where("df <> 0 or tf <> 0")
        chunks = both.groupBy("sign", "chunk_id", "token_len").agg(F.lit(1).alias("one"))
        totals = chunks.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("token_len")), F.lit(0)).cast("long").alias("sum_len"))
        return (fresh if fresh is not None else gone.limit(0)), names, frequencies, totals

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text") -> str:
        """Writes a change as a new segment and gives its name."""
        return self._write(*self.change(added, removed, id_col, text_col))

    def _write(self, postings: DataFrame, names: DataFrame, frequencies: DataFrame, totals: DataFrame, compacted: bool = False) -> str:
        number, name = 1 + max((r.number for r in self._marks()), default=-1), uuid.uuid4().hex
        for table, rows in (("postings", postings), ("frequencies", frequencies)):
            dealt = rows.withColumn("bucket", self.bucket(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
            dealt.write.partitionBy("bucket").parquet(f"{self.path}/{table}/{name}")
        names.write.parquet(f"{self.path}/removed/{name}")
        totals.coalesce(1).write.parquet(f"{self.path}/totals/{name}")
        mark = self.spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("name"), F.lit(number if compacted else 0).cast("long").alias("first"), F.lit(postings.schema["chunk_id"].dataType.simpleString()).alias("kind"))
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        return name

    def compact(self) -> str:
        """One segment in place of all so far."""
        postings = self.postings()
        return self._write(postings, postings.select("chunk_id").limit(0), self.frequencies(), self.totals(), True)

    def opened(self, queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> tuple[DataFrame, Bm25Index]:
        """The queries' tokens, and the index of their buckets alone."""
        asked = written(asked_tokens(queries, query_col, text_col).withColumn("bucket", self.bucket(F.col("token"))), "bm25-query-tokens")
        touched = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # at most as many as there are buckets
        return asked.drop("bucket"), self.index(touched)

    def score(self, queries: DataFrame, query_col: str = "query_id", text_col: str = "text", chunk_name: Column | None = None, k: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score) as bm25.score gives them; chunk_name may give chunks another id."""
        asked, index = self.opened(queries, query_col, text_col)
        if chunk_name is not None:
            index = replace(index, postings=index.postings.withColumn("chunk_id", chunk_name))
        return score_asked(index, asked, k=k)

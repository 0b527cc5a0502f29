"""A chunk store in a folder: hash buckets of Parquet files, of which a batch rewrites only those it touches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.tables import written
from granary.operators.sync import upsert_chunk_store


class ChunkStore:
    """Rows (chunk_id, doc_id, text ...), one a chunk_id, in buckets by the hash of chunk_id.

    A batch is merged with the old rows of its buckets, and the result is written before anything is replaced. Then
    Spark's dynamic partition overwrite moves the finished buckets in, all at the end of its job: a batch that fails on
    the way leaves every old file in place, and buckets without a row of the batch keep theirs by name. A batch that is
    run again gives the same rows. Batches must not run at the same time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The store's rows, of some buckets or of all."""
        try:
            found = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("bucket")

    def upsert(self, batch: DataFrame, order_col: str) -> list[int]:
        """Takes a batch in, the last row of a chunk_id by order_col; gives the buckets that were rewritten. Rows without
        id, document or text are dropped."""
        batch = written(upsert_chunk_store(self.rows([]), batch, order_col), "chunk-batch")
        touched = sorted(r.b for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        if touched:
            old = self.rows(touched).join(batch.select("chunk_id"), "chunk_id", "left_anti").select(batch.columns)
            merged = written(old.unionByName(batch).withColumn("bucket", self._bucket()), "chunk-merged")
            dealt = merged.hint("rebalance", "bucket")  # a bucket a task, large ones over several
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return touched

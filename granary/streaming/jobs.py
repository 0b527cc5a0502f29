"""Ingestion of changed documents as a stream of batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.tables import scratch, written
from granary.operators import blocks as B
from granary.operators import bm25
from granary.operators import sections as S
from granary.operators.sync import diff_documents

def line_chunks(documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, source_path, text): a document's lines."""
    rows = documents.select("doc_id", "source_path", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rows.select(F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), "doc_id", "source_path", "text")


def parsed_chunks(documents: DataFrame) -> DataFrame:
    """The leaves of hierarchical chunks of what parsing and cleaning leave of each text document: blocks, title
    fragments joined, sections, chunks."""
    blocks = B.text_blocks(documents).withColumns({"html": F.lit(None).cast("string"), "extra": F.lit(None).cast("map<string,string>"), "page_no": F.lit(None).cast("int")})
    sections = S.build_sections(B.block_section_text(blocks))
    parts = sections.select(F.concat_ws("#", "doc_id", "section_index").alias("doc_id"), "text")
    leaves = S.hierarchical_chunks(parts).where("chunk_role = 'leaf'").withColumn("doc_id", F.regexp_replace("doc_id", "#[0-9]+$", ""))
    return leaves.join(documents.select("doc_id", "source_path").distinct(), "doc_id").select("chunk_id", "doc_id", "source_path", "text")


class IngestStore:
    """A collection's state, chunks and BM25 statistics in a shared folder, as a log of batches.

    A batch writes only its own rows, under its number: new states of the paths that changed, chunks of new content,
    and what the statistics change by. Then it adds its marker; readers see marked batches only. A batch that ran
    before finds its marker and does nothing, one that was cut short is written anew, so a restart repeats no work and
    loses none. Rows are also dealt to buckets by source path, and a batch reads the buckets it touches, so its cost
    follows its size. compact() folds the log into one batch; that happens by itself after fold_every batches, so readers
    open a bounded number of folders. A batch's working tables are deleted when it is done."""

    STATE = "source_path string, doc_id string, sha256 string, deleted boolean"
    CHUNKS = "chunk_id string, doc_id string, source_path string, text string"

    def __init__(self, spark: SparkSession, path: str, chunks_of: Callable[[DataFrame], DataFrame] = line_chunks, buckets: int = 64, fold_every: int = 32):
        self.spark, self.path, self.chunks_of, self.buckets, self.fold_every = spark, path, chunks_of, buckets, fold_every

    def _marks(self) -> list[tuple[int, bool]]:
        """(batch, whether all before it is folded into it), a row a batch since the last folding."""
        try:
            rows = self.spark.read.schema("version long, whole boolean").parquet(f"{self.path}/done")
            first = rows.agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("version"))), F.lit(-1)).alias("v")).first().v
            return sorted({(r.version, r.whole) for r in rows.where(F.col("version") >= first).collect() if r.whole or r.version > first})
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def version(self) -> int:
        return max((v for v, _ in self._marks()), default=-1)

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{table}/{'whole' if whole else 'part'}/version={v}" for v, whole in self._marks()]
        parts = [self.spark.read.schema(f"{schema}, bucket int").parquet(f).withColumn("version", F.lit(int(f.rsplit("=", 1)[1])).cast("long")) for f in folders]
        rows = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], f"{schema}, bucket int, version long"))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def state(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest state of each path that is there."""
        rows = self._read("state", self.STATE, buckets)
        last = rows.groupBy("source_path").agg(F.max_by(F.struct("doc_id", "sha256", "deleted", "bucket", "version"), "version").alias("s"))
        return last.select("source_path", "s.*").where("not deleted").drop("deleted")

    def chunks(self, buckets: list[int] | None = None) -> DataFrame:
        """The chunks of each path's newest content."""
        rows = self._read("chunks", self.CHUNKS, buckets)
        return rows.join(self.state(buckets).select("source_path", "version"), ["source_path", "version"]).select("chunk_id", "doc_id", "source_path", "text")

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        """Document frequencies and totals, as bm25.build_index would count them over chunks()."""
        return bm25.summed(self._read("frequencies", "token string, df long").select("token", "df"), self._read("totals", "n long, sum_len long").select("n", "sum_len"))

    def _write(self, table: str, rows: DataFrame, version: int, whole: bool = False) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{'whole' if whole else 'part'}/version={version}")

    def _mark(self, version: int, whole: bool = False) -> None:
        self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(whole).alias("whole")).coalesce(1).write.mode("append").parquet(f"{self.path}/done")

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        """Takes documents (source_path, doc_id, text, and optionally deleted) of a batch as the newest of their paths;
        of several rows of a path in one batch a deletion comes last, then the larger text."""
        if batch_id <= self.version():
            return
        with scratch(self.spark):
            self._take(batch, batch_id)
            if len(self._marks()) >= self.fold_every:
                self.compact()

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        gone = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        now = batch.select("source_path", F.struct(gone.alias("deleted"), "text", "doc_id").alias("d")).groupBy("source_path").agg(F.max("d").alias("d"))
        now = written(now.select("source_path", "d.*", F.sha2("d.text", 256).alias("sha256"), F.pmod(F.xxhash64("source_path"), F.lit(self.buckets)).cast("int").alias("bucket")), "ingest-batch")
        touched = [r.bucket for r in now.select("bucket").distinct().collect()]  # at most as many as there are buckets
        before = self.state(touched).join(now.select("source_path"), "source_path", "left_semi")
        actions = diff_documents(before, now.where("not deleted")).where("action <> 'unchanged'").select("source_path", "action")
        changed = written(now.join(actions, "source_path"), "ingest-changed")
        fresh = written(self.chunks_of(changed.where("action <> 'deleted'").select("source_path", "doc_id", "text")).select("chunk_id", "doc_id", "source_path", "text"), "ingest-chunks")
        old = self.chunks(touched).join(changed.select("source_path"), "source_path", "left_semi")
        frequencies, totals = bm25.delta_of(bm25.counts(old), bm25.counts(fresh))
        self._write("chunks", fresh.join(changed.select("source_path", "bucket"), "source_path").select("chunk_id", "doc_id", "source_path", "text", "bucket"), batch_id)
        self._write("state", changed.select("source_path", "doc_id", "sha256", (F.col("action") == "deleted").alias("deleted"), "bucket"), batch_id)
        self._write("frequencies", frequencies.withColumn("bucket", F.lit(0)), batch_id)
        self._write("totals", totals.withColumn("bucket", F.lit(0)), batch_id)
        self._mark(batch_id)

    def compact(self) -> None:
        """Folds all batches so far into the newest, so that readers and batches read one folder a table."""
        now, state = self.version(), self.state()
        frequencies, totals = self.statistics()
        self._write("chunks", self.chunks().join(state.select("source_path", "bucket"), "source_path").select("chunk_id", "doc_id", "source_path", "text", "bucket"), now, True)
        self._write("state", state.select("source_path", "doc_id", "sha256", F.lit(False).alias("deleted"), "bucket"), now, True)
        self._write("frequencies", frequencies.withColumn("bucket", F.lit(0)), now, True)
        self._write("totals", totals.withColumn("bucket", F.lit(0)), now, True)
        self._mark(now, True)


def stream_ingest(documents: DataFrame, store: IngestStore, checkpoint: str):
    """Starts the query that ingests every micro-batch of a stream of documents."""
    return documents.writeStream.foreachBatch(store.ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

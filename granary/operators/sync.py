"""Incremental sync of a document collection: content diffs, library status, chunk stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import filled


def diff_documents(old: DataFrame, current: DataFrame) -> DataFrame:
    """(source_path, action, doc_id, old_sha256, new_sha256): added, updated, deleted or unchanged. A missing hash
    differs from any other."""
    o = old.select("source_path", F.col("doc_id").alias("old_doc_id"), F.col("sha256").alias("old_sha256"), F.lit(True).alias("was"))
    n = current.select("source_path", F.col("doc_id").alias("new_doc_id"), F.col("sha256").alias("new_sha256"), F.lit(True).alias("now"))
    both = o.join(n, "source_path", "full_outer")
    action = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "unchanged").otherwise("updated")
    return both.select("source_path", action.alias("action"), F.coalesce("new_doc_id", "old_doc_id").alias("doc_id"), "old_sha256", "new_sha256")


def next_state(old: DataFrame, current: DataFrame, now) -> DataFrame:
    """The state after a scan: rows of current; updated_at stays unless the content is new or changed."""
    diff = diff_documents(old, current).where("action <> 'deleted'").select("source_path", "action")
    before = old.select("source_path", F.col("updated_at").alias("before"))
    rows = current.join(diff, "source_path").join(before, "source_path", "left")
    kept = F.when(F.col("action") == "unchanged", F.coalesce("before", F.lit(now))).otherwise(F.lit(now))
    return rows.withColumn("updated_at", kept).withColumn("last_seen_at", F.lit(now)).drop("action", "before")


def sync_library(library: DataFrame, scanned: DataFrame, indexed: DataFrame) -> DataFrame:
    """Library rows after a scan: seen files active, and indexed or pending; unseen active ones deleted and pending."""
    seen = scanned.select("source_path", "file_size", F.lit(True).alias("seen"))
    rows = library.select("source_path", "status", "index_status", F.col("file_size").alias("old_size")).join(seen, "source_path", "full_outer").join(indexed.select("source_path").distinct().withColumn("in_index", F.lit(True)), "source_path", "left")
    here = F.coalesce("seen", F.lit(False))
    gone = ~here & (F.col("status") == "active")
    status = F.when(here, "active").when(gone, "deleted").otherwise(F.col("status"))
    index = F.when(here, F.when(F.coalesce("in_index", F.lit(False)), "indexed").otherwise("pending")).when(gone, "pending").otherwise(F.col("index_status"))
    return rows.select(F.concat(F.lit("doc_"), F.substring(F.sha1("source_path"), 1, 32)).alias("library_id"), "source_path", status.alias("status"), index.alias("index_status"), F.coalesce("file_size", "old_size").alias("file_size"))


def apply_document_diff(chunks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk store without the chunks of deleted and updated documents, and with those of added and updated ones."""
    gone = diff.where(F.col("action").isin("deleted", "updated")).select("doc_id").distinct()
    come = diff.where(F.col("action").isin("added", "updated")).select("doc_id").distinct()
    return chunks.join(gone, "doc_id", "left_anti").unionByName(fresh.join(come, "doc_id", "left_semi"))


def upsert_chunk_store(base: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """The store after a batch: its last row a chunk_id replaces the old one; rows without id, document or text are dropped."""
    whole = filled(F.col("chunk_id")).isNotNull() & filled(F.col("doc_id")).isNotNull() & filled(F.col("text")).isNotNull()
    last = batch.where(whole).withColumn("back", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc(order_col)))).where("back = 1").drop("back", order_col)
    return base.join(last, "chunk_id", "left_anti").select(last.columns).unionByName(last)

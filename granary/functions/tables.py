"""Helpers over whole tables: writing an intermediate one once, sized broadcasts, numbers in order."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a narrow table that a join is told to broadcast.
BROADCAST_ROWS = 200_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only a local session may leave that
    unset and gets a folder of its own."""
    if (found := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"
    if (kept := getattr(_SCRATCH, "paths", None)) is not None:
        kept.append(path)
    return path


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the folders that the block made with work_dir, in this thread, at its end: for jobs that run for weeks.
    What the block returns must not read them."""
    outer, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in map(hadoop, _SCRATCH.paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.paths = outer


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own, for what several branches of a plan read; lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(table: DataFrame) -> DataFrame:
    """A written narrow table for the small side of a join: broadcast if its counted rows are few, else left alone."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with 0-based numbers in order of a unique column: range partitions are numbered each by itself and written,
    then shifted by the sizes of those before, so no task sees all rows."""
    parts = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    parts = written(parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(order))), "numbered")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("size"))  # a row a partition
    base = sizes.select("_part", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("_base"))
    return parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_place") - 1).drop("_part", "_place", "_base")

"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it; the same bytes that bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a test or production folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may leave it unset: it
    gets a folder of its own. On a cluster that is an error, as no folder of the driver's would do."""
    if (found := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Cleanup:
    """Keeps shuffle clean-up on while any thread of the driver writes; the last one puts the setting back."""

    lock, writers, before = threading.Lock(), 0, "false"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        with _Cleanup.lock:
            if not _Cleanup.writers:
                _Cleanup.before = self.spark.conf.get(CLEANUP)
            _Cleanup.writers += 1
            self.spark.conf.set(CLEANUP, "true")

    def __exit__(self, *_):
        with _Cleanup.lock:
            _Cleanup.writers -= 1
            if not _Cleanup.writers:
                self.spark.conf.set(CLEANUP, _Cleanup.before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back: lineage ends there, the files outlive
    any executor, and the shuffles that made them are cleaned up at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    with _Cleanup(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few numbers each that a join is told to broadcast (some 32 MB).
BROADCAST_ROWS = 1_000_000


def if_small(table: DataFrame) -> DataFrame:
    """A narrow materialised table for the small side of a join: broadcast if its counted rows are few enough, else
    left to a shuffle join."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def shared_value(spark: SparkSession, make: Callable, *parts) -> Callable:
    """Broadcasts plain parts (arrays, dicts, lists); calling the result in a worker gives make(*parts). Only make goes
    along by value, so executors need no copy of this package, and a worker holds the parts once."""
    box = spark.sparkContext.broadcast(parts)
    return lambda: make(*box.value)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    if files := df.inputFiles():
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns an operator reads, under its own names, so that other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with set-up: make() runs once a task and gives the function that is applied to slices of batches.

    A slice has at most SLICE rows. Spark is told to make its batches no larger (see small_batches), so an executor and
    its workers hold few whole texts at a time."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    yield step(batch.slice(at, SLICE))
        finally:  # a worker serves many tasks: what one has loaded must not wait for the collector while the next loads
            del step
            gc.collect()

    return df.mapInArrow(run, schema)


#: Rows that a Python worker takes at a time, and Spark's setting for the rows of the Arrow batches that it hands over.
SLICE = 512
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to SLICE rows; a smaller bound stays. Spark reads the setting when a plan runs,
    so it holds from here on."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= SLICE:
        spark.conf.set(BATCH_ROWS, str(SLICE))


def spans_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items that hold at most `most` in all; a larger item has a range of its own."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def multipliers(n: int, seed: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """Odd 64-bit numbers. What has been made is kept in a plain dict, which goes to workers by value."""
    if (n, seed) not in known:
        known[n, seed] = np.array([xxhash.xxh64_intdigest(f"{seed} {i}".encode(), seed) | 1 for i in range(n)], np.uint64)
    return known[n, seed]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(6))), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def gram_hashes(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every run of k words, given the words' hashes."""
    n = len(hashes) - k + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i, c in enumerate(multipliers(k, seed)):
            total += hashes[i : i + n] * c
    return mixed(total)

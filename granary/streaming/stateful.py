"""Stateful streaming jobs: session memory with timers and expiry, and a cache that serves stored results to repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.tables import written
from granary.operators.memory import RECENT, TRIGGER

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000
MEMORY = "session_id long, action string, message_count long, recent_ids array<long>, evicted_message_count long, new_message_ids array<long>, covered_until_message_id long, covered_message_count long"
SERVED = "request_id long, cache_key string, us long, status string, source_request long, stored_us long"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed states with timers live in RocksDB, on the executors' disks and in the query's checkpoint."""
    spark.conf.set(STORE, ROCKS)


class SessionMemory(StatefulProcessor):
    """State of one session: a list of the messages that no summary covers yet (the last `recent` at least), and the
    counts. Messages leave the list when they are compressed, so it has at most `trigger` rows between batches."""

    def __init__(self, recent: int, trigger: int, expire_ms: int | None, by_event: bool):
        self.recent, self.trigger, self.expire_ms, self.by_event = recent, trigger, expire_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.by_event else self.expire_ms  # by the machine's clock the store forgets by itself
        self.handle = handle
        self.open = handle.getListState("open", "message_id long", ttl)
        self.counts = handle.getValueState("counts", "messages long, covered_until long, covered long, last_ms long", ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, until, covered, last = self.counts.get() or (0, -1, 0, 0)
        ids = [r[0] for r in self.open.get()] if self.open.exists() else []
        for batch in rows:
            count += len(batch)
            ids += batch["message_id"].tolist()
            last = max(last, int(batch["us"].max()) // 1000)
        ids.sort()
        new = [i for i in ids[: -self.recent] if i > until]
        compress = count > self.trigger and bool(new)
        if compress:
            until, covered, ids = new[-1], covered + len(new), ids[-self.recent :]
        self.open.put([(i,) for i in ids])
        self.counts.update((count, until, covered, last))
        if self.expire_ms is not None:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last if self.by_event else timerValues.getCurrentProcessingTimeInMs()) + self.expire_ms)
        yield self._row(key, "compress" if compress else "keep", count, ids[-self.recent :], max(0, count - self.recent), new if compress else [], until, covered)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, until, covered, _ = self.counts.get() or (0, -1, 0, 0)
        self.open.clear()
        self.counts.clear()
        yield self._row(key, "expire", count, [], 0, [], until, covered)

    @staticmethod
    def _row(key: Any, action: str, count: int, recent: list, evicted: int, new: list, until: int, covered: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "action": [action], "message_count": [count], "recent_ids": [recent], "evicted_message_count": [evicted], "new_message_ids": [new], "covered_until_message_id": pd.array([until if until >= 0 else None], "Int64"), "covered_message_count": [covered]})


def stream_session_memory(messages: DataFrame, recent: int = RECENT, trigger: int = TRIGGER, expire_days: float | None = 7, clock: str = "event", late: str = "1 hour") -> DataFrame:
    """A row for each session that a batch touches: `compress`, with the ids that its summary takes up now, where it has
    more than `trigger` messages and some left the last `recent` uncovered; else `keep`; `expire` when it is forgotten.

    messages: session_id, message_id, ts. A session is forgotten expire_days after its last message and begins anew: by
    the messages' own time (clock="event": timers on the watermark, which waits `late`; rows that are later still are
    dropped), or by the machine's (clock="processing": the store's own expiry, with timers that report it). Rows of one
    session may come in any order within a batch; one that is older than what a summary covers only counts. State does
    not grow with a session. The union of a session's compressed ids equals compression_plan's over all its messages,
    where they come in order, however they are cut into batches."""
    use_rocksdb(messages.sparkSession)
    event = clock == "event"
    rows = messages.select("session_id", "message_id", "ts", F.unix_micros("ts").alias("us"))
    rows = rows.withWatermark("ts", late) if event else rows
    processor = SessionMemory(recent, trigger, None if expire_days is None else int(expire_days * DAY_MS), event)
    return rows.groupBy("session_id").transformWithStateInPandas(processor, MEMORY, "Update", "EventTime" if event else "ProcessingTime")


class ResultCache(StatefulProcessor):
    """State of one key: the request whose result is stored, and when."""

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "request_id long, at_us long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        source, at = self.stored.get() or (None, None)
        before, out = at, []
        for us, request in sorted((r.us, r.request_id) for r in rows):  # one batch's repeats of one key
            fresh = at is None or us >= at + self.keep_us
            if fresh:
                source, at = request, us
            out.append(Row(request_id=request, cache_key=key[0], us=us, status="computed" if fresh else "served", source_request=source, stored_us=at))
        if at != before:
            self.stored.update((source, at))
            if before is not None:
                self.handle.deleteTimer(self._frees(before))
            self.handle.registerTimer(self._frees(at))
        return iter(out)

    def _frees(self, at: int) -> int:
        """When the timer of what was stored at that time fires, so that timers need not be listed."""
        return (at + self.keep_us) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.stored.clear()
        return iter([])


def stream_query_dedupe(requests: DataFrame, key: str = "cache_key", ts: str = "ts", id_col: str = "request_id", keep_hours: float = 6, late: str = "10 minutes") -> DataFrame:
    """(request_id, cache_key, ts, status, source_request, stored_at), a row for every request: `computed`, or `served`
    by the result of source_request, stored at stored_at.

    The first request of a key is computed, and so is the next one that comes keep_hours or more after it: expiry counts
    from the store, not from the last read. Time is the requests' own. A request that comes later than the watermark,
    which waits `late`, is dropped. State is a request id and a time a key; a timer frees it when it has expired."""
    use_rocksdb(requests.sparkSession)
    rows = requests.select(F.col(id_col).cast("long").alias("request_id"), F.col(key).cast("string").alias("cache_key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts)).alias("us"))
    marked = rows.withWatermark("ts", late).groupBy("cache_key").transformWithState(ResultCache(int(keep_hours * 3600 * 1e6)), SERVED, "Append", "EventTime")
    return marked.select("request_id", "cache_key", F.timestamp_micros("us").alias("ts"), "status", "source_request", F.timestamp_micros("stored_us").alias("stored_at"))


class ServedResults:
    """Where results of computed requests are kept and served from, in a shared folder.

    answer(requests) gives the result rows of computed requests (request_id, cache_key), with their request_id. Each
    batch writes the results it computed, by the day they were stored, and its answers: every request with its result
    rows. Both go to folders of the batch's own, which a repeated batch overwrites, so a restart answers nothing twice.
    A batch reads the results of the days its requests were stored on, not all of them."""

    def __init__(self, spark: SparkSession, path: str, answer: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.answer = spark, path, answer

    def take(self, marked: DataFrame, batch_id: int) -> None:
        """Answers a batch of stream_query_dedupe's rows; for foreachBatch."""
        rows = written(marked.withColumn("day", F.date_format("stored_at", "yyyy-MM-dd")), "served-batch")
        computed = rows.where("status = 'computed'")
        fresh = self.answer(computed.select("request_id", "cache_key")).withColumnRenamed("request_id", "source_request")
        fresh = fresh.join(computed.select("source_request", "day"), "source_request").withColumn("batch", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/results")
        days = [r.day for r in rows.select("day").distinct().collect()]  # a batch's hours and six more
        names = [c for c in fresh.columns if c not in ("day", "batch")]
        try:
            stored = self.spark.read.schema(fresh.select(*names, "day", "batch").schema).parquet(f"{self.path}/results").where(F.col("day").isin(days))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = fresh.limit(0)
        rows.drop("day").join(stored.select(*names), "source_request", "left").write.mode("overwrite").parquet(f"{self.path}/answers/batch={batch_id}")

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/answers")

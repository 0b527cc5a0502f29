"""Session memory and served results as streams, batch by batch, against their batch rules."""

import json
import random
import time
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.operators import memory
from granary.plans.registry import Tables
from granary.streaming.stateful import ResultCache, ServedResults, stream_query_dedupe, stream_session_memory

SF = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(hours):
    return (DAY + timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Feed:
    """A folder of JSON files that a stream reads one batch at a time."""

    def __init__(self, spark, path, schema):
        self.path, self.n = path / "in", 0
        self.path.mkdir()
        self.stream = spark.readStream.schema(schema).json(str(self.path))
        self.names = [x.split()[0] for x in schema.split(", ")]

    def add(self, query, rows):
        (self.path / f".{self.n}.tmp").write_text("\n".join(json.dumps(dict(zip(self.names, r))) for r in rows))
        (self.path / f".{self.n}.tmp").rename(self.path / f"{self.n}.json")
        self.n += 1
        query and query.processAllAvailable()


MESSAGES = "session_id long, message_id long, ts timestamp"


def session_stream(spark, tmp_path, **options):
    feed, out = Feed(spark, tmp_path, MESSAGES), []
    query = stream_session_memory(feed.stream, **options).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    return feed, out, query


def test_session_memory_equals_the_batch_plan_however_it_is_cut(spark, tmp_path):
    messages = [(r.session_id, r.message_id) for r in Tables(spark, SF).messages.orderBy("session_id", "message_id").collect()]
    rng, cut = random.Random(2), {}
    for s, m in messages:  # each session's messages in order, dealt over five batches
        cut.setdefault(s, []).append(m)
    batches = [[] for _ in range(5)]
    for s, ids in cut.items():
        places = sorted(rng.choices(range(5), k=len(ids)))
        for place, m in zip(places, ids):
            batches[place].append((s, m, at(place)))
    feed, out, query = session_stream(spark, tmp_path)
    for rows in batches:
        rng.shuffle(rows)
        feed.add(query, rows)
    query.stop()
    none = spark.createDataFrame([], "session_id long, covered_until_message_id long, covered_message_count long")
    plan = {r.session_id: r for r in memory.compression_plan(Tables(spark, SF).messages, none).collect()}
    got = {}
    for r in out:
        seen = got.setdefault(r.session_id, {"new": []})
        seen["new"] += r.new_message_ids
        seen["last"] = max(seen.get("last", r), r, key=lambda x: x.message_count)
    assert got.keys() == plan.keys()
    for s, p in plan.items():
        last = got[s]["last"]
        assert (last.message_count, last.evicted_message_count, last.recent_ids) == (p.message_count, p.evicted_message_count, cut[s][-memory.RECENT :])
        assert got[s]["new"] == (p.new_message_ids if p.should_compress else [])
        assert last.covered_message_count == len(got[s]["new"]) and last.covered_until_message_id == (got[s]["new"] or [None])[-1]
    assert sum(1 for r in out if r.action == "compress") > len(plan) / 2


def test_session_is_forgotten_seven_days_after_its_last_message(spark, tmp_path):
    feed, out, query = session_stream(spark, tmp_path)
    feed.add(query, [(1, i, at(0)) for i in range(14)] + [(2, 50, at(0))])
    feed.add(query, [(2, 51, at(7 * 24 - 2))])  # session 2 lives on, 1 is just not due yet
    assert not [r for r in out if r.action == "expire"]
    feed.add(query, [(3, 90, at(7 * 24 + 3))])  # the watermark passes seven days after session 1
    feed.add(query, [(1, 14, at(7 * 24 + 3)), (2, 52, at(7 * 24 + 3)), (2, 49, at(1))])  # the last one is late and dropped
    query.stop()
    rows = [(r.session_id, r.action, r.message_count, r.recent_ids) for r in out]
    assert rows.count((1, "expire", 14, [])) == 1 and (1, "compress", 14, list(range(8, 14))) in rows
    assert (1, "keep", 1, [14]) in rows and (2, "keep", 3, [50, 51, 52]) in rows
    assert [r for r in rows if r[1] == "expire"] == [(1, "expire", 14, [])]


def test_session_expires_by_the_machines_clock(spark, tmp_path):
    """With such timers a stream goes on making batches, so the test waits for rows instead of for the input's end."""
    feed, out, query = session_stream(spark, tmp_path, clock="processing", expire_days=8 / 86400)

    def wait(action, n):
        end = time.time() + 60
        while sum(r.action == action for r in out) < n and time.time() < end:
            time.sleep(0.2)

    try:
        feed.add(None, [(1, 1, at(0)), (1, 2, at(0))])
        wait("keep", 1)
        wait("expire", 1)
        time.sleep(1)
        feed.add(None, [(1, 3, at(0))])
        wait("keep", 2)
    finally:
        query.stop()
    assert [(r.message_count, r.recent_ids) for r in out if r.action == "keep"] == [(2, [1, 2]), (1, [3])]
    assert "expire" in [r.action for r in out]


REQUESTS = "request_id long, cache_key string, ts timestamp"


def plain_cache(rows, keep=6):
    """{request: (status, source)} of rows (request, key, hours), by key in order of time."""
    stored, out = {}, {}
    for request, key, hours in sorted(rows, key=lambda r: (r[2], r[0])):
        fresh = key not in stored or hours >= stored[key][1] + keep
        if fresh:
            stored[key] = (request, hours)
        out[request] = ("computed" if fresh else "served", stored[key][0])
    return out


def test_every_request_is_answered_and_replay_equals_the_batch_rule(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted(((i, rng.choice("abc"), round(rng.uniform(0, 60), 3)) for i in range(120)), key=lambda r: r[2])
    rows += [(200, "a", 60.5), (201, "a", 60.5), (202, "z", 61)]  # a tie, and a key asked once
    asked = []

    def answer(requests):
        asked.extend(r.request_id for r in requests.collect())
        return requests.select("request_id", F.explode(F.array(F.concat("cache_key", F.lit("-one")), F.concat("cache_key", F.lit("-two")))).alias("result"), F.col("request_id").alias("made_by"))

    feed, served = Feed(spark, tmp_path, REQUESTS), ServedResults(spark, f"{tmp_path}/served", answer)
    query = stream_query_dedupe(feed.stream).writeStream.foreachBatch(served.take).option("checkpointLocation", f"{tmp_path}/cp").start()
    for i in range(0, len(rows), 41):
        feed.add(query, [(r, k, at(h)) for r, k, h in rows[i : i + 41]])
    query.stop()
    want, got = plain_cache(rows), {}
    for r in served.answers().collect():
        got.setdefault(r.request_id, []).append((r.status, r.source_request, r.result, r.made_by))
    assert got.keys() == want.keys()
    for (request, key, _) in rows:
        status, source = want[request]
        assert sorted(got[request]) == [(status, source, f"{key}-one", source), (status, source, f"{key}-two", source)]
    assert sorted(asked) == sorted(r for r, w in want.items() if w[0] == "computed")


def test_late_requests_are_dropped_and_a_repeated_batch_overwrites(spark, tmp_path):
    out, feed = [], Feed(spark, tmp_path, REQUESTS)
    query = stream_query_dedupe(feed.stream).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
    feed.add(query, [(1, "a", at(0)), (2, "a", at(5.99))])
    feed.add(query, [(3, "a", at(5)), (4, "b", at(5.9)), (5, "a", at(6))])  # 3 is later than ten minutes, 4 is not
    feed.add(query, [(6, "a", at(11.99)), (7, "a", at(12)), (8, "c", at(30))])
    feed.add(query, [(9, "a", at(31))])
    query.stop()
    assert {(r.request_id, r.status, r.source_request) for r in out} == {(1, "computed", 1), (2, "served", 1), (4, "computed", 4), (5, "computed", 5), (6, "served", 5), (7, "computed", 7), (8, "computed", 8), (9, "computed", 9)}
    served = ServedResults(spark, f"{tmp_path}/served", lambda df: df.select("request_id", F.lit(1).alias("v")))
    marked = spark.createDataFrame([tuple(r) for r in out[:2]], "request_id long, cache_key string, ts timestamp, status string, source_request long, stored_at timestamp")
    for _ in range(2):
        served.take(marked, 0)
    assert sorted((r.request_id, r.v) for r in served.answers().collect()) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("rows", [[], [(1, "a", 0)]])
def test_empty_and_single_batches(spark, tmp_path, rows):
    spark.createDataFrame([(r, k, DAY) for r, k, _ in rows], REQUESTS).write.parquet(f"{tmp_path}/in")
    query = stream_query_dedupe(spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.read.schema(REQUESTS).parquet(f"{tmp_path}/out").count() == len(rows)


def test_a_key_asks_its_store_no_more_than_it_needs():
    """A key's timer is known from its state: no timers are listed, and only a replaced one is deleted."""
    calls, state = [], {}

    class Fake:
        def getValueState(self, *_):  # noqa: N802
            return SimpleNamespace(get=lambda: state.get("v"), update=lambda v: state.update(v=v))

        def registerTimer(self, ms):  # noqa: N802
            calls.append(("register", ms))

        def deleteTimer(self, ms):  # noqa: N802
            calls.append(("delete", ms))

    cache = ResultCache(1000)
    cache.init(Fake())
    ask = lambda *rows: [(r.request_id, r.status, r.source_request) for r in cache.handleInputRows(("k",), iter([Row(request_id=i, us=us) for i, us in rows]), None)]
    assert ask((2, 500), (1, 0)) == [(1, "computed", 1), (2, "served", 1)]
    assert ask((3, 999)) == [(3, "served", 1)]
    assert ask((4, 1000)) == [(4, "computed", 4)]
    assert calls == [("register", 2), ("delete", 2), ("register", 3)]

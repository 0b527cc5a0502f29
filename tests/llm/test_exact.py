import hashlib
import re
from collections import defaultdict

from granary.llm.exact import exact_duplicates, op2_exact_refine

SCHEMA = "doc_id long, text string, keep_id string, n int"


def plain(rows):
    groups = defaultdict(list)
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[body(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[body(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[body(t)]), i == keep, hashlib.sha256(body(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op2_exact_refine(spark, sf).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_lazy_digests_agree_and_odd_rows(spark):
    long = "word\t" * 50_000
    rows = [(4, None), (2, ""), (9, " "), (8, "\n \t"), (7, "a  b"), (1, "a\x0bb"), (3, "a b"), (6, long), (5, long.replace("\t", "  ")), (None, "a b"), (None, "alone"), (10, "x" * 300 + "y"), (11, "x" * 300 + "z"), (7, "a  b")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA)
    for every in (True, False):
        got = exact_duplicates(df, digest_all=every).collect()
        want = plain(rows)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
        hashes = {(w[0], w[4]) for w in want}
        assert all((r.doc_id, r.text_sha256) in hashes for r in got if r.text_sha256)
        assert all(r.text_sha256 for r in got) == every
        assert exact_duplicates(spark.createDataFrame([], SCHEMA), digest_all=every).count() == 0


def test_workers_are_handed_few_rows_at_a_time(spark):
    """Spark's own Arrow batches, not only the slices of them, are bounded; a smaller bound is kept."""
    from granary.llm.common import BATCH_ROWS, SLICE, map_batches

    def most(rows):
        def make():
            return lambda batch: batch.from_arrays([[len(batch)], [batch.column(0).offset]], ["n", "offset"])

        return map_batches(spark.range(rows).coalesce(1), make, "n long, offset long").agg({"n": "max", "offset": "max"}).first()

    before = spark.conf.get(BATCH_ROWS)
    try:
        spark.conf.set(BATCH_ROWS, "10000")
        assert sorted(most(3000)) == [0, SLICE]  # no slice begins inside a batch
        spark.conf.set(BATCH_ROWS, "100")
        assert sorted(most(3000)) == [0, 100]
    finally:
        spark.conf.set(BATCH_ROWS, before)

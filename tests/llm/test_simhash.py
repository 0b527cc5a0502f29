import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm.simhash import close_pairs, fingerprint_bits, near_duplicates, op1_simhash_pivots

SCHEMA = "doc_id long, text string, component_id string, fp int"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=3):
    ids, parent = list(fps), {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(ids, 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_matches_plain_count():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 40, 700):
        text = " ".join(rng.choice(["Ab", "cé", "DE", "f\tg", "ÀÉ"]) for _ in range(n))
        assert fingerprint_bits(text.encode(), 3) == plain_fingerprint(text)


def test_close_pairs_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps = set(base)
    for x in base:
        for flips in range(1, 6):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(63, flips, replace=False)))
    fps = sorted(fps | {0, -1})
    want = {(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for blocks in (5, 6):
        assert {(r[0], r[1]) for r in close_pairs(df, 3, blocks).collect()} == want
    with pytest.raises(ValueError):
        close_pairs(df, 3, 3)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op1_simhash_pivots(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (3, "", "y", 2), (7, " \t\n", None, None), (9, "one", "z", 0), (8, "one", "z", 0), (8, "one", "z", 0), (None, "one", "z", 0), (1, "long " * 60_000, "", 0)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert by[5] == by[3] == by[7] == {3}
    assert by[9] == by[8] == by[None] == {8}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame(rows, SCHEMA)).select(F.sum("n_links")).first()[0] == 0

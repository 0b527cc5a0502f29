from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.mixing import entropy, mix_sources, op9_temperature_mix, temperature_weights

SCHEMA = "doc_id long, source string, n int, text string, epoch string"


def test_weights_meet_entropy_or_repeats():
    n = [900, 60, 30, 10, 0]
    w = temperature_weights(list("abcde"), n, 1000, target_entropy=1.0)
    assert entropy(w.weights) == pytest.approx(1.0, abs=1e-6) and w.weights.sum() == pytest.approx(1) and w.weights[4] == 0
    limited = temperature_weights(list("abcde"), n, 1000, target_entropy=1.0, most_repeats=2)
    assert limited.exponent > w.exponent and max(limited.weights[:4] * 1000 / np.array(n[:4])) == pytest.approx(2)
    assert temperature_weights(["a"], [5], 100, most_repeats=2).exponent == 1.0
    assert temperature_weights(list("ab"), [9, 1], 10, target_entropy=5.0).exponent == pytest.approx(0, abs=1e-9)
    assert temperature_weights([], [], 0).weights.size == 0


def check(rows, got, budget, block_tokens):
    """Every rule that the result is meant to keep, from the input alone."""
    docs, total = defaultdict(dict), Counter()
    for i, s, n in rows:
        docs[s or ""][i] = n
        total[s or ""] += n
    used, taken = defaultdict(lambda: defaultdict(list)), Counter()
    for r in got:
        assert docs[r.source][r.doc_id] == r.n_tokens
        used[r.source][r.epoch].append((r.block, r.place, r.doc_id))
        taken[r.source] += r.n_tokens
    for s, epochs in used.items():
        weight = next(r.weight for r in got if r.source == s)
        quota, last = weight * budget, max(epochs)
        biggest = max(docs[s].values())
        assert taken[s] <= quota + 1e-6 and taken[s] > quota - biggest - 1e-6
        for e, order in epochs.items():
            assert len({d for *_, d in order}) == len(order) and len({o[:2] for o in order}) == len(order)
            if e < last:
                assert {d for *_, d in order} == set(docs[s])
        if len(epochs) > 1 and len(docs[s]) > 20:
            assert [d for *_, d in sorted(epochs[0])] != [d for *_, d in sorted(epochs[1])]
    return used


@pytest.mark.parametrize("block_tokens", [50, 10_000])
def test_quota_epochs_and_blocks(spark, block_tokens):
    rng = np.random.default_rng(1)
    rows = [(i, s, int(rng.integers(1, 9))) for i, s in enumerate(["big"] * 600 + ["mid"] * 120 + [None] * 40 + [""] * 10)]
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], SCHEMA)
    budget = sum(r[2] for r in rows) * 1.5
    got = mix_sources(df, budget, most_repeats=6, tokens=F.col("n"), block_tokens=block_tokens).collect()
    used = check(rows, got, budget, block_tokens)
    assert len(used[""]) > 1
    again = mix_sources(df.repartition(3), budget, most_repeats=6, tokens=F.col("n"), block_tokens=block_tokens).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_many_blocks_and_repeated_ids(spark):
    """More blocks than a group holds, and rows of one doc_id with other counts: the result depends on rows alone."""
    rng = np.random.default_rng(2)
    rows = [(i, "a", int(rng.integers(1, 4))) for i in range(9000)] + [(i, "a", 5 + i % 3) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], SCHEMA)
    mix = lambda d: sorted(map(tuple, mix_sources(d, 9000, tokens=F.col("n"), block_tokens=2).collect()))
    got = mix(df)
    assert sum(r[5] for r in got) <= 9000 and sum(r[5] for r in got) > 9000 - 8 and len({r[3] for r in got}) > 2500
    assert got == mix(df.repartition(5))


def test_query_keeps_its_rules(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, len(r.text.split())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, op9_temperature_mix(spark, sf).collect(), sum(r[2] for r in rows), 100_000)


def test_odd_rows(spark):
    rows = [(1, "a", 1, None, ""), (2, "a", 1, "", ""), (3, "b", 1, "w " * 100_000, ""), (4, None, 1, "one two", ""), (None, "a", 1, "x", ""), (5, "c", 1, "", None), (4, None, 1, "one two", "")]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.source for r in got} <= {"b", ""}
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0

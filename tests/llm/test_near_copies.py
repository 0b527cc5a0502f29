"""Wide SimHash near-copies against all pairs' Jaccard similarity."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from granary.llm import simhash


def plain(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_components(texts):
    """Smallest id that pairs of Jaccard similarity of 0.8 or more reach, by comparing all pairs."""
    sets, found = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if similar(sets[a], sets[b])]
    for _ in texts:
        before = dict(found)
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
        if before == found:
            return found, links


def components_of(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_copies(docs, **options).collect()}


def test_odd_rows_and_chains(spark):
    rng = np.random.default_rng(3)
    texts, line = {}, "all rights reserved by the owner of this page"
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60 + i)]
        for j in range(4):
            texts[10 * i + j] = " ".join([*words, line])
            words[rng.integers(len(words))] = f"n{rng.integers(0, 10**9)}"
    texts |= {990: None, 991: " ", 992: "one two", 993: "One  two", 994: "one two three", 995: line, 996: line + " x", 997: "long " * 300_000}
    want, links = plain_components(texts)
    got = components_of(spark, texts)
    assert len(links) > 80 and got.keys() == want.keys()
    sets = {i: plain(t) for i, t in texts.items()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)  # nearly every link is found
    for i, c in got.items():  # and nothing else is: each row lies in its plain component
        assert want[i] == want[c]
    assert got[991] == 990 and got[993] == 992 and got[994] == 994 and sets[997] and got[997] == 997


def test_recall_of_edited_copies(spark):
    """Pairs at a similarity of 0.8 to 0.95 among unrelated texts: 9 of 10 are found, and no unrelated ones."""
    rng = np.random.default_rng(5)
    texts, links = {}, []
    for i in range(1500):
        words = [f"w{x}" for x in rng.integers(0, 20_000, 150)]
        texts[2 * i] = " ".join(words)
        for at in rng.choice(len(words), rng.integers(1, 4), replace=False):
            words[at] = "edited"
        texts[2 * i + 1] = " ".join(words)
        if similar(plain(texts[2 * i]), plain(texts[2 * i + 1])):
            links.append((2 * i, 2 * i + 1))
    got = components_of(spark, texts)
    assert len(links) > 800
    assert sum(got[a] == got[b] for a, b in links) >= 0.95 * len(links)
    assert all(c in (i, i - i % 2) for i, c in got.items())


def test_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """A group of 1,500 near copies becomes one component from candidates in proportion to its rows."""
    rng, seen = np.random.default_rng(7), []
    words = [f"w{x}" for x in rng.integers(0, 20_000, 120)]
    texts = {i: " ".join(w if rng.random() > 0.008 else f"e{rng.integers(10**9)}" for w in words) for i in range(1500)}
    real = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda rows, pairs, *a: (seen.append(pairs.count()), real(rows, pairs, *a))[1])
    got = components_of(spark, texts)
    largest = max(sum(c == x for c in got.values()) for x in set(got.values()))
    assert largest > 1300 and sum(seen) < 1500 * 1499 // 2 / 5


def test_rows_about_a_large_group_are_not_compared_with_it(spark, monkeypatch):
    """400 near copies of a text and 400 rows that differ too much from it, and from each other, for a link: their pairs
    lie in the same cells, but only some for each row are compared on whole sets, and no link is lost."""
    rng, seen = np.random.default_rng(11), []
    words = [f"w{x}" for x in rng.integers(0, 20_000, 120)]
    edited = lambda n: {int(x) for x in rng.choice(120, n, replace=False)}
    texts = {}
    for i in range(800):
        at = edited(rng.integers(1, 4) if i % 2 else rng.integers(5, 8))
        texts[i] = " ".join(f"e{i} {w}" if p in at else w for p, w in enumerate(words))
    real = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda rows, pairs, *a: (seen.append(pairs.count()), real(rows, pairs, *a))[1])
    want, links = plain_components(texts)
    got = components_of(spark, texts)
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    assert len(set(got.values())) > 300 and sum(seen) < 20 * len(texts)


def test_cells_are_whole_where_shingles_are_counted(spark, monkeypatch):
    """In one cell of all rows: pairs that share rare shingles alone, and pairs that share common ones alone, are found."""
    rng, real = np.random.default_rng(13), simhash.sketches
    monkeypatch.setattr(simhash, "FEW", 4)
    monkeypatch.setattr(simhash, "wide_candidates", lambda fps, *a: fps.selectExpr("doc_id as a", "doc_id as b", "0 as distance", "false as apart").where("false"))
    monkeypatch.setattr(simhash, "sketches", lambda *a: real(*a).withColumn("keys", F.transform("keys", lambda k: k * 0)))
    words = [f"w{x}" for x in rng.integers(0, 20_000, 120)]
    texts = {i: " ".join([*words[: 120 - i], *(f"e{i}x{j}" for j in range(i))]) for i in range(40)}
    for i in range(100, 160, 2):
        own = [f"r{x}" for x in rng.integers(0, 20_000, 90)]
        texts |= {i: " ".join(own), i + 1: " ".join([*own, "more", "words"])}
    want, _ = plain_components(texts)
    assert components_of(spark, texts) == want


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long, keys string")
    assert simhash.near_copies(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y")], "doc_id long, text string, n long, keys string")
    assert {tuple(r) for r in simhash.near_copies(docs).collect()} == {(1, 1), (2, 1)}


def test_partners_far_apart_in_one_cell(spark, monkeypatch):
    """All rows have the same keys, so they lie in one cell: a near copy 59 rows further on is found, and no other."""
    rng, real = np.random.default_rng(9), simhash.sketches
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 20_000, 80)) for i in range(60)}
    texts[59] = texts[0] + " end"
    monkeypatch.setattr(simhash, "sketches", lambda *a: real(*a).withColumn("keys", F.transform("keys", lambda k: k * 0)))
    assert components_of(spark, texts) == {i: i % 59 for i in texts}

import hashlib
import random

from granary.llm import substring
from granary.llm.substring import duplicate_spans, factors, op6_substring_rlz

SCHEMA = "doc_id long, text string, spans string"


def plain(rows, window=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain(docs))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op6_substring_rlz(spark, sf).collect()) == want
    assert any(g for _, _, g, _ in want)


def test_removal_comes_from_factors(spark, monkeypatch):
    """Nothing but the parse's factors decides: without them nothing goes, and a longer factor takes more words."""
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "x " + text + " y")], "doc_id long, text string")
    assert rows_of(duplicate_spans(df))[1][2] == 30
    monkeypatch.setattr(substring, "factors", lambda found, window: [])
    assert [r[2] for r in rows_of(duplicate_spans(df))] == [0, 0]


def test_random_texts_and_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices("abc", k=rng.randrange(30))) for _ in range(3)]
        if rows and rng.random() < 0.6:
            old = (rng.choice(rows)[1] or "").split()
            cut = rng.randrange(len(old) + 1)
            parts.insert(rng.randrange(4), " ".join(old[cut : cut + rng.randrange(40)]))
        rows.append((rng.randrange(1000), " \t".join(parts)))
    rows += [(2000, None), (2001, ""), (None, rows[0][1]), (2002, "z " * 50_000), (2003, "z " * 50_000), (2002, "z " * 50_000), (2004, " ".join("word%d" % i for i in range(12)))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert rows_of(duplicate_spans(df)) == plain(rows)
    assert rows_of(duplicate_spans(df, window=4)) == plain(rows, 4)
    assert duplicate_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans_name_their_source(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, "x " + text), (2, "new " + " ".join(text.split()[5:30]) + " end")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in duplicate_spans(df).collect()}
    assert got[1] == [] and [tuple(s) for s in got[2]] == [(1, 26, 1, 6)]


def test_factors_break_where_the_source_does():
    assert factors([(0, 1, 1, 4), (1, 1, 1, 5), (2, 1, 2, 9), (5, 4, 2, 12)], 3) == [(0, 4, 1, 4), (2, 5, 2, 9), (5, 11, 2, 12)]

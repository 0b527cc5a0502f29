import numpy as np
import pytest

from granary.llm.language import ORDER, START, build_trees, op3_language_ppm, predict_languages, train_language_trees

SCHEMA = "doc_id long, text string, lang string, score string"


def plain_code_length(grams, least, text):
    """PPM of one language by dictionaries: method C, lower orders renormalised over symbols not seen above."""
    counts = {}
    for g, n in grams.items():
        for k in range(ORDER + 1):
            row = counts.setdefault(g[ORDER - k : ORDER], {})
            row[g[ORDER]] = row.get(g[ORDER], 0) + n

    def row(context):
        low = [1 / 256] * 256 if not context else row(context[1:])
        seen = counts.get(context, {})
        if context and sum(seen.values()) < least or not seen:
            return low
        n, kinds = sum(seen.values()), len(seen)
        rest = sum(low[s] for s in range(256) if s not in seen)
        return [seen[s] / (n + kinds) if s in seen else kinds / (n + kinds) * low[s] / rest for s in range(256)]

    data, total = START + text, 0.0
    for i in range(ORDER, len(data)):
        total -= np.log2(row(data[i - ORDER : i])[data[i]])
    return total


def test_code_lengths_equal_plain_ppm():
    texts = {"a": b"the cat sat on the mat and the rat sat on the hat " * 3, "b": "el niño come pan y el perro come carne ".encode() * 3}
    grams = {}
    for lang, t in texts.items():
        d, g = START + t, {}
        for i in range(len(t)):
            g[d[i : i + 4]] = g.get(d[i : i + 4], 0) + 1
        grams[lang] = g
    packed = {k: (np.array([int.from_bytes(x, "big") for x in g]), np.array(list(g.values()))) for k, g in grams.items()}
    trees = build_trees(packed, 1)
    probe = [b"the pan sat", b"z", "el ñu".encode(), b"the cat " * 40]
    got = trees.code_lengths(probe)
    for i, p in enumerate(probe):
        for j, lang in enumerate(trees.langs):
            assert got[i, j] == pytest.approx(plain_code_length(grams[lang], 1, p), rel=1e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    import granary.llm.language as module

    packed = {"a": (np.array([int.from_bytes(b"abca", "big"), int.from_bytes(b"bcab", "big"), int.from_bytes(b"cabc", "big")]), np.array([9, 9, 9]))}
    trees = build_trees(packed, 1)
    text = b"abcabcabxcabc" * 30
    whole = trees.code_lengths([text, b"abc", text])
    monkeypatch.setattr(module, "CHUNK", 17)
    assert trees.code_lengths([text, b"abc", text]) == pytest.approx(whole)


def test_held_out_accuracy_and_schema(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_language_ppm(spark, sf)
    joined = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(joined) > 200
    assert np.mean([r.lang_pred == r.lang for r in joined]) > 0.95
    assert all(0 <= r.score <= 1 for r in joined)


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat " * 30, "en", "x"), (2, "el perro come pan " * 30, "es", None), (3, None, "en", None), (4, "123 !?", "en", None), (5, "", None, None), (6, "el pan", None, None), (6, "el pan", None, None), (None, "the mat", "en", None), (7, "the cat " * 200_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    trees = train_language_trees(df, least_count=2)
    got = [(r.doc_id, r.lang_pred) for r in predict_languages(df, trees).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "es"), (3, "und"), (4, "und"), (5, "und"), (6, "es"), (6, "es"), (None, "en"), (7, "en")], key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert predict_languages(empty, trees).count() == 0
    assert {r.lang_pred for r in predict_languages(df, train_language_trees(empty)).collect()} == {"und"}

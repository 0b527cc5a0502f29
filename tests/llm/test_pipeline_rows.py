"""Each stage decides by row: rows with null and repeated doc_ids."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 200 and text not like '%!!%'").orderBy("doc_id").limit(30).collect()
    return [r.text for r in rows]


def run(spark, name, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert name == "encode" or got.columns == docs.columns
    return got.collect()


def test_language_by_row(spark, texts):
    rows = [*((i, t, "a") for i, t in enumerate(texts)), (None, texts[0], "a"), (1, "12 34 56", "a"), (None, "--- 1", "a")]
    got = Counter((r.doc_id, r.text) for r in run(spark, "language", rows))
    assert got == Counter((i, t) for i, t, _ in rows[:-2])


def test_language_rejects_junk_and_foreign_texts(spark, texts):
    rng = np.random.default_rng(1)
    junk = ["это русский текст который не имеет никакого отношения к языкам собрания " * 3, "".join(map(chr, rng.integers(33, 127, 400))), "".join(rng.choice(list("qzxjkvw"), 400)), "这是一个中文文本与其他语言没有任何关系" * 10]
    rows = [*((i, t, "a") for i, t in enumerate(texts)), *((100 + 4 * i, t, "a") for i, t in enumerate(junk))]
    docs = spark.createDataFrame([(i, t, "en" if i < 100 else None, s, len(t)) for i, t, s in rows], SCHEMA)
    got = corpus_pipeline.language(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == list(range(len(texts)))


def test_stages_keep_other_columns(spark, texts):
    """Columns beside those of documents, with names that stages use themselves, come through."""
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "x", i) for i, t in enumerate(texts)], SCHEMA + ", bits string, component_id long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and all(r.bits == "x" and r.component_id == r.doc_id for r in got.collect()), name


def test_very_long_text_passes_all_stages(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate([*texts, " ".join(texts) * 60])], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name in ("language", "exact", "near"):
            assert {r.doc_id for r in docs.collect()} >= {len(texts)}
    assert docs.count() > 0


def test_exact_by_row(spark, texts):
    rows = [(None, texts[0], "a"), (5, texts[0], "a"), (5, texts[0], "a"), (5, texts[1], "a"), (3, texts[1], "a"), (None, texts[2], "a"), (None, texts[2], "a"), (None, texts[3], "a")]
    got = Counter((r.doc_id, r.text) for r in run(spark, "exact", rows))
    assert got == Counter([(5, texts[0]), (3, texts[1]), (None, texts[2]), (None, texts[3])])


def test_near_by_row(spark, texts):
    close = [t + " more" for t in texts]
    rows = [(None, texts[0], "a"), (5, close[0], "a"), (5, texts[0], "a"), (5, close[1], "a"), (3, texts[1], "a"), (None, texts[2], "a"), (None, close[2], "a"), (None, texts[3], "a"), (7, texts[4], "a"), (7, texts[4], "a")]
    got = run(spark, "near", rows)
    assert sorted(str(r.doc_id) for r in got) == ["3", "5", "7", "None", "None"]
    assert {r.text for r in got if r.doc_id == 5} <= {texts[0], close[0]} and {r.text for r in got} > {texts[1], texts[3], texts[4]}


def test_mix_by_row(spark, texts):
    rows = [*((7, texts[0], "a") for _ in range(4)), (None, texts[1], "a"), (7, texts[2], "a"), (7, texts[3], "b"), (None, texts[4], "b")]
    got = run(spark, "mix", rows)
    words = lambda ts: sum(len(t.split()) for t in ts)
    assert words(r.text for r in got) <= words(t for _, t, _ in rows)
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(rows) and any(r.doc_id is None for r in got)


def test_encode_by_row(spark, texts):
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (5, texts[2], "a"), (5, texts[2], "a")]
    assert len(run(spark, "encode", rows)) == len(rows)

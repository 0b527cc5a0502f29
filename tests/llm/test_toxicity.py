import math

import numpy as np

from granary.llm.toxicity import WordModel, features, fit_nnpu, op4_toxicity_nnpu, score_toxicity, text_words, train_toxicity

SCHEMA = "doc_id long, text string, score int"


def test_learns_from_positives_and_unlabelled_alone():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(60)]
    draw = lambda bad: set(rng.choice(plain, 12)) | ({"vile"} if bad else set())
    positive = [draw(True) for _ in range(80)]
    unlabelled = [draw(rng.random() < 0.2) for _ in range(400)]
    model = fit_nnpu([features(w) for w in positive], [features(w) for w in unlabelled], 0.2)
    assert model.score("w1 w2 vile") > 0.5 > model.score("w1 w2 w3")
    assert fit_nnpu([], unlabelled, 0.2).weights == {}


def plain_fit(positive, unlabelled, prior, rounds, rate=0.05, decay=2e-4):
    """The same descent with the risk's terms written out and slopes taken by differences."""
    words = sorted(set().union(*positive, *unlabelled))
    x = {w: 0.0 for w in words} | {None: math.log(prior / (1 - prior))}
    z = lambda text: x[None] + sum(x[w] for w in text)
    good = lambda texts: sum(math.log1p(math.exp(-z(t))) for t in texts) / len(texts)
    bad = lambda texts: sum(math.log1p(math.exp(z(t))) for t in texts) / len(texts)
    rest = lambda: bad(unlabelled) - prior * bad(positive)
    m, v, turned = dict.fromkeys(x, 0.0), dict.fromkeys(x, 0.0), 0
    for t in range(1, rounds + 1):
        back = rest() < 0
        turned += back
        risk = (lambda: -rest()) if back else (lambda: prior * good(positive) + rest())
        slope = {}
        for k in x:
            here = x[k]
            x[k] = here + 1e-5
            up = risk()
            x[k] = here - 1e-5
            slope[k] = (up - risk()) / 2e-5 + (0 if k is None else decay * ((here > 0) - (here < 0)))
            x[k] = here
        for k in x:
            m[k], v[k] = 0.9 * m[k] + 0.1 * slope[k], 0.999 * v[k] + 0.001 * slope[k] ** 2
            x[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return x, turned


def test_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    draw = lambda bad: set(rng.choice(["a", "b", "c", "d"], 2)) | ({"vile"} if bad else set())
    positive, unlabelled = [draw(True) for _ in range(12)], [draw(i % 5 == 0) for i in range(30)]
    for prior in (0.2, 0.6):
        want, turned = plain_fit(positive, unlabelled, prior, 120)
        model = fit_nnpu(positive, unlabelled, prior, 120)
        assert abs(model.bias - want.pop(None)) < 2e-3
        assert all(abs(model.weights.get(w, 0.0) - x) < 2e-3 for w, x in want.items())
    assert turned > 0  # the higher prior makes the second term negative, so reversed steps are compared too


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = op4_toxicity_nnpu(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    tp, fp, fn = ((got.predicted == 1) & (got.toxic == 1)).sum(), ((got.predicted == 1) & (got.toxic == 0)).sum(), ((got.predicted == 0) & (got.toxic == 1)).sum()
    print(tp, fp, fn)
    assert tp / (tp + fp) > 0.8 and tp / (tp + fn) > 0.8


def test_scores_equal_plain_sums(spark):
    """Every score of the query's operator from weights and features by hand, and the prior as labels have it."""
    rows = [(i, f"{'vile ' * (i % 10 == 0)}word{i % 7} fine" if i % 9 else None, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i == 10)) for i in range(1000)], "key long, toxic int")
    model = train_toxicity(df, labels, labels_id_col="key")
    # one positive of 1,000 labelled: its words say next to nothing beside the prior's odds
    assert set(model.weights) <= {"fine", "^fine", "word", "^word"} and all(abs(x) < 0.01 for x in model.weights.values())
    assert model.score("") < 0.01
    model = WordModel({"vile": 2.0, "^vile": 0.5, "^word": -0.25, "fine": 0.125}, -1.0)
    for r in score_toxicity(df, model).collect():
        text = rows[r.doc_id][1] or ""
        z = -1.0 + 2.5 * ("vile" in text) - 0.25 * ("word" in text) * 1 + 0.125 * ("fine" in text)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-12 and r.predicted == int(r.score >= 0.5)


def test_odd_rows(spark):
    rows = [(i, "you vile thing " + "ok " * (i % 5) if i % 4 == 0 else "a fine day " + "ok " * (i % 5), 1) for i in range(400)]
    rows += [(1000, None, 1), (1001, "", 1), (None, "vile", 1), (1002, "VILE " * 100_000, 1), (1002, "VILE", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 if i % 8 == 0 else 0) for i in range(0, 400, 2)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = train_toxicity(df, labels)
    got = score_toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id == 1002} == {1}
    assert score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert train_toxicity(spark.createDataFrame([], SCHEMA), labels).weights == {}
    assert text_words("Ab, cÉ-d 12") == {"ab", "cé", "d"} and WordModel({}, 0.0).score(None) == 0.5

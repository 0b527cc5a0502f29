from collections import Counter

import numpy as np
import pytest

from granary.llm.lm_score import ADDED, BACKOFF, cross_entropy_difference, op8_cross_entropy_difference

SCHEMA = "doc_id long, text string, n_words string"
SF = "/root/testdata/sf0.001"


def plain_models(target, background):
    """P(word | word before) of either side, by dictionaries; None is a word of neither."""
    words = lambda t: ["<s>", *(t or "").encode().lower().split()]
    sides = []
    for side in (target, background):
        texts = [words(t) for t in side]
        sides.append((Counter(w for t in texts for w in t[1:]), Counter(u for t in texts for u in t[:-1]), Counter(p for t in texts for p in zip(t, t[1:]))))
    vocabulary = {*sides[0][0], *sides[1][0]}

    def model(single, contexts, pairs):
        alone = lambda w: (single[w] + ADDED) / (single.total() + ADDED * (len(vocabulary) + 1))
        return lambda u, w: (pairs[u, w] + BACKOFF * alone(w)) / (contexts[u] + BACKOFF)

    return vocabulary, [model(*s) for s in sides]


def plain_losses(target, background, texts):
    _, models = plain_models(target, background)
    pairs = lambda t: list(zip(["<s>", *(w := (t or "").encode().lower().split())], w))
    return [[np.mean([-np.log(p(u, w)) for u, w in pairs(t)]) if pairs(t) else None for t in texts] for p in models]


def test_probabilities_after_a_context_add_up_to_one(spark):
    """Losses of two-word texts are turned back into the probabilities of their second words."""
    target, background = ["a b a c", "b"], ["a b", "c c a b d"]
    vocabulary, models = plain_models(target, background)
    names = [w.decode() for w in sorted(vocabulary)] + ["never-seen"]
    for side, p in zip(("target_loss", "background_loss"), models):
        for before in (b"a", b"d", b"new"):
            assert sum(p(before, w.encode()) for w in names) == pytest.approx(1)
            texts = [f"{before.decode()} {w}" for w in names] + [before.decode()]
            found = {r.doc_id: r[side] for r in cross_entropy_difference(table(spark, texts), table(spark, target), table(spark, background)).collect()}
            assert sum(np.exp(found[len(names)] - 2 * found[i]) for i in range(len(names))) == pytest.approx(1)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("own_background", [True, False])
def test_losses_equal_plain_models(spark, own_background):
    rng = np.random.default_rng(0)
    draw = lambda p: [" ".join(rng.choice(["A", "b", "c", "d", "e", "f"], 25, p=p)) for _ in range(20)]
    target, background = draw([0.5, 0.3, 0.1, 0.05, 0.03, 0.02]), draw([0.1, 0.1, 0.2, 0.2, 0.2, 0.2])
    texts = background if own_background else [*background, "a a b", "z z", "f", ""]
    got = sorted(cross_entropy_difference(table(spark, texts), table(spark, target), None if own_background else table(spark, background)).collect())
    want = plain_losses(target, background, texts)
    for r, t, b in zip(got, *want):
        assert (r.target_loss, r.background_loss) == (pytest.approx(t), pytest.approx(b)) and r.difference == (None if t is None else pytest.approx(t - b))
    assert sum(r.difference for r in cross_entropy_difference(table(spark, target), table(spark, target), table(spark, background)).collect()) < sum(r.difference or 0 for r in got)


def test_rare_words_count(spark):
    """A text that stands twice in a large corpus of words of their own is told from those that stand once."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(300)]
    got = sorted(cross_entropy_difference(table(spark, texts + texts[:3]), table(spark, ["other words"])).collect())
    twice, once = [r.difference for r in got if r.doc_id in (0, 1, 2, 300, 301, 302)], [r.difference for r in got if 2 < r.doc_id < 300]
    assert min(twice) > max(once) + 0.4


def test_query_equals_plain_models(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = dict(zip(docs, zip(*plain_losses(target, list(docs.values()), list(docs.values())))))
    got = op8_cross_entropy_difference(spark, SF).collect()
    assert {r.doc_id: r.n_words for r in got} == {i: len(t.split()) for i, t in docs.items()}
    assert all((r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id]) for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "one"), (5, "long word " * 80_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = cross_entropy_difference(df, df).collect()
    assert len(got) == len(rows) and all(r.difference is None if not r.n_words else abs(r.difference) < 1e-9 for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert cross_entropy_difference(empty, empty).count() == 0
    assert len(cross_entropy_difference(df, empty, empty).collect()) == len(rows)

def test_words_that_occur_once_are_not_joined(spark, monkeypatch):
    """The tables of words' counts that are broadcast have the words that occur more than once alone."""
    from granary.llm import lm_score

    seen, own = [], lm_score.if_small
    monkeypatch.setattr(lm_score, "if_small", lambda table: seen.append(table.count()) or own(table))
    texts = [f"w{i} common z{i}" for i in range(50)] + ["once"]
    got = sorted(cross_entropy_difference(table(spark, texts), table(spark, ["common w3", "new z4"])).collect())
    assert sum(seen) == 5  # common, w3, new, z4 and the beginning
    for r, t, b in zip(got, *plain_losses(["common w3", "new z4"], texts, texts)):
        assert (r.target_loss, r.background_loss) == (pytest.approx(t), pytest.approx(b))

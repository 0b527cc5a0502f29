import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.spelling import minimal_acceptor, near_words, one_edit_pairs, op12_spelling_fst, spelling_variants, text_runs, vocabulary, with_slips


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def plain(n):
    """{word: (form, root, n, n_near, form_n)} by deletions: words one edit apart meet at a string with a gap."""
    meet = defaultdict(set)
    for w in n:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + "\0" + w[i + 1 :]].add(w)
            meet[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def result(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len({w for w, _ in rows}) == len(rows)
    return dict(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = plain(plain_words([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]))
    assert result(op12_spelling_fst(spark, sf)) == want
    assert any(x[0] for x in want.values())


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", max_size=6), max_size=40), st.integers(1, 7))
def test_composition_accepts_each_pair_once(words, most):
    got = [tuple(sorted(p)) for p in one_edit_pairs(sorted(words), most)]
    place = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b) and place(a, b) < most)


def test_acceptor_is_minimal_and_exact():
    words = sorted({a + b for a in ("walk", "talk", "", "ba") for b in ("ed", "ing", "s")} | {"x" * 5000})
    arcs, final, start = minimal_acceptor(words)
    assert len({(f, *a.items()) for a, f in zip(arcs, final)}) == len(arcs)
    found, todo = [], [(start, "")]
    while todo:
        p, w = todo.pop()
        found += [w] if final[p] else []
        todo += [(q, w + c) for c, q in arcs[p].items()]
    assert sorted(found) == words


def test_hot_partitions_are_cut_without_loss(spark):
    rng = random.Random(5)
    stem = "donaudampfschiff"
    words = {stem + "".join(rng.choices("abc", k=rng.randint(5, 9))) for _ in range(700)} | {"".join(rng.choices("ab", k=rng.randint(7, 9))) for _ in range(300)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "é" * 7, "é" * 8, "z" * 3000, "z" * 3001}
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    want = sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b))
    for most in (4, 64, 2048):
        assert sorted((r.word, r.other) for r in near_words(df, most).collect()) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 ?"), (None, "Variant variant VARIANT"), (4, "variants " * 40), (4, "variants"), (5, "variantes " * 900), (6, "Äußerung äußerung " * 3), (7, "x" * 20_000 + " " + "x" * 20_000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, run string, n int")
    runs = text_runs(df)
    words = vocabulary(runs.select(with_slips(runs.run, runs.doc_id, 31).alias("word")))
    got = result(spelling_variants(words))
    assert got == plain(plain_words(rows))
    assert got["variants"][:2] == ("variantes", "variantes") and got["variant"][:2] == ("variants", "variantes")
    assert result(spelling_variants(vocabulary(text_runs(df.limit(0)).select("run").withColumnRenamed("run", "word")))) == {}

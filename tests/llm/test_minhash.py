import random
from collections import defaultdict

import numpy as np

from granary.llm.minhash import COORDINATES, match_threshold, minhash_duplicates, op11_minhash_inverted, shingle_hashes, signatures, sign_planes

SCHEMA = "doc_id long, text string, c long, digest string, n int"


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {b" ".join(words)} - {b""}


def plain(rows, k, percent):
    """Sorted (doc_id, n_shingles, component_id, kept), by comparing all sets that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    where, parent = defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        met = {j for g in s for j in where[g]}
        for j in met:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both) and find(i) != find(j):
                parent[find(i)] = find(j)
        for g in s:
            where[g].append(i)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min((d for d in groups[find(i)] if d is not None), default=None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(op11_minhash_inverted(spark, sf))
    assert got == plain(rows, 3, 85)
    assert any(not r[3] for r in got)


def test_families_chains_and_templates_lose_no_link(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(60):  # families of a few edits around one text
        base = [word() for _ in range(rng.randint(8, 200))]
        texts += [base] + [edited(rng, base, rng.randint(1, max(1, len(base) // 25))) for _ in range(rng.randint(0, 12))]
    hot = [word() for _ in range(150)]
    texts += [edited(rng, hot, rng.randint(1, 5)) for _ in range(250)]  # a large family, not all of it linked directly
    template = [word() for _ in range(100)]
    texts += [template + [word() for _ in range(30)] for _ in range(80)]  # alike, but not enough
    chain = [word() for _ in range(120)]
    for _ in range(30):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA).repartition(7)
    assert found(minhash_duplicates(df, shingle_words=3, similarity=0.85)) == plain(rows, 3, 85)
    assert found(minhash_duplicates(df)) == plain(rows, 5, 80)


def test_exact_border(spark):
    # 20 shingles; 17 of them and none else: 17 / 20 = 0.85 links, 16 / 19 does not
    whole = [f"b{i}" for i in range(22)]
    rows = [(1, " ".join(whole)), (2, " ".join(whole[:19])), (3, " ".join(f"c{i}" for i in range(21))), (4, " ".join(f"c{i}" for i in range(18)))]
    df = spark.createDataFrame([(*r, 1, "", 2) for r in rows], SCHEMA)
    got = found(minhash_duplicates(df, shingle_words=3, similarity=0.85))
    assert got == plain(rows, 3, 85) and [r[2] for r in got] == [1, 1, 3, 3 if 100 * 16 >= 85 * 19 else 4]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, None), (4, ""), (9, " \t\n"), (8, None), (7, "One two"), (6, "one\x0btwo"), (3, "É è a"), (2, "é è a"), (None, "one  TWO"), (None, "alone here now"), (None, None), (11, long), (10, long + " tail"), (12, "a b c"), (12, "a b c"), (12, "other text here")]
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], SCHEMA)
    assert found(minhash_duplicates(df, shingle_words=3, similarity=0.85)) == plain(rows, 3, 85)
    assert found(minhash_duplicates(df.limit(0))) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(300):
        both, a, b = rng.integers(0, 1 << 63, 850, np.uint64), rng.integers(0, 1 << 63, 75, np.uint64), rng.integers(0, 1 << 63, 75, np.uint64)
        sets += [np.concatenate([both, a]), np.concatenate([both, b])]
    sig = signatures(sets)
    same = (sig[::2] == sig[1::2]).sum(1)
    assert abs(same.mean() / COORDINATES - 0.85) < 0.01 and abs(same.std() - (COORDINATES * 0.85 * 0.15) ** 0.5) < 0.5
    assert same.min() >= match_threshold(0.85) and 35 < match_threshold(0.85) < 45
    planes = sign_planes(sig)
    apart = np.bitwise_or.reduce(planes[::2] ^ planes[1::2], axis=1)
    assert all(COORDINATES - int(x).bit_count() >= s for x, s in zip(apart.view(np.uint64), same))


def test_shingles():
    assert len(shingle_hashes("a b c d", 3)) == 2 and len(shingle_hashes("a b", 3)) == 1 and len(shingle_hashes(" ", 3)) == 0
    assert (shingle_hashes("A b\tc", 3) == shingle_hashes("a B c", 3)).all() and shingle_hashes("É", 3) != shingle_hashes("é", 3)

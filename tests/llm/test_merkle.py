import hashlib
import zlib
from collections import defaultdict

import pytest

from granary.llm import merkle
from granary.llm.merkle import build_block, fold, manifest_leaves, merkle_proofs, op13_merkle_veb, proof_digest, sibling_path, veb_addresses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nodes string, g int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """All levels, and for each leaf its siblings with their side."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            path.append((at ^ 1 < at, level[at ^ 1]) if at ^ 1 < len(level) else (None, None))
            at >>= 1
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) -> sorted results."""
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = defaultdict(list)
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        groups[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r)), r[0], leaf(r), leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (_, i, own, seen), path in zip(sorted(groups[g], key=lambda x: x[0]), trees[g][1]):
            for left, beside in path + top:
                seen = H(seen) if left is None else H(beside, seen) if left else H(seen, beside)
            out.append((i, own, trees[g][0], root, H(*(b for _, b in path + top if b)), seen, seen == root))
    return sorted(out, key=str)


def tampered_rows(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 1) for r in rows], SCHEMA)
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted((tuple(r) for r in merkle_proofs(manifest_leaves(df, {"n_chars": seen})).collect()), key=str)


def test_addresses_are_a_permutation_and_split_at_half_height():
    for height in range(8):
        flat = sorted(int(a) for depth in veb_addresses(height) for a in depth)
        assert flat == list(range((2 << height) - 1))
    # seven nodes in three levels: two levels above, four single nodes below; fifteen in four: three below each of four
    assert [x.tolist() for x in veb_addresses(2)] == [[0], [1, 4], [2, 3, 5, 6]] or [x.tolist() for x in veb_addresses(2)] == [[0], [1, 2], [3, 4, 5, 6]]
    assert veb_addresses(3)[2].tolist() == [3, 6, 9, 12] and veb_addresses(3)[3].tolist() == [4, 5, 7, 8, 10, 11, 13, 14]


def test_block_and_paths_equal_plain_tree():
    for n in range(1, 20):
        leaves = [H(str(i)) for i in range(n)]
        height = (n - 1).bit_length()
        nodes = build_block([bytes.fromhex(x) for x in leaves], height)
        root, paths = plain_tree(leaves)
        assert nodes[:32].hex() == root
        for at, leaf in enumerate(leaves):
            path = sibling_path(nodes, height, n, at)
            assert fold(leaf, path) == root and proof_digest(path) == H(*(b for _, b in paths[at] if b))
            assert fold(H("other"), path) != root


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op13_merkle_veb(spark, sf).collect()), key=str)
    assert got == plain(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


ODD = [
    (7, "a", "en", 3, "abc"), (7, "a", "en", 3, "abc"), (7, "b", "en", None, None), (None, None, None, None, None), (None, "x", "en", 5, ""),
    (11, "x", "", 5, "é–"), (12, None, None, 9, "long " * 50_000), (13, "s", "Ünder", -4, "\n\t"), (14, "s", "zz", 0, "z"),
]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_odd_rows_and_several_levels_of_blocks(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "BLOCK_HEIGHT", height)
    rows = ODD + [(i, "s", "en" if i % 3 else f"l{i}", i, f"text {i}") for i in range(100, 140)]
    assert tampered_rows(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert tampered_rows(spark, []) == []
    assert tampered_rows(spark, ODD[:1]) == plain(ODD[:1])

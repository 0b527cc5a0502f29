import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from granary.llm.bpe import ByteBpe, PairTable, decode_ids, encode_texts, op7_byte_bpe, read_ranks, round_trip

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string"


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_equal_library():
    rng, own, lib = random.Random(2), ByteBpe.load(PATH, P.PATTERN), library()
    alphabet = "aeiou thnsr ETA éüñß 12 .,!\n\t日本 🙂'sll"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(400))) for _ in range(300)]
    texts += ["", "a", "e" * 255, "ab" * 700, "x" * 257 + " y", "日本語" * 200, "word" * 64, "<|endoftext|>"]
    texts += ["".join(rng.choices("etaoins", k=n)) for n in (257, 300, 1000, 5000, 100_000)] + ["=" * 3001, "ab" * 50_000, " " * 700]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_wide_rows_of_ranks_out_of_order():
    """Tokens whose later merges have smaller ranks: merging all pairs at once would differ."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 300, b"bab": 299, b"abab": 298, b"aa": 297, b"ba": 301, b"aab": 296}
    own = ByteBpe(ranks, P.PATTERN, PairTable.build(ranks))
    lib = tiktoken.Encoding("odd", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    pieces = ["".join(rng.choices("ab", k=n)) for n in (258, 300, 900, 2000)] + ["ab" * 400, "aab" * 300]
    assert own.alone.any()
    for piece, ids in zip(pieces, own.encode(pieces)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(piece)


def test_query_equals_library(spark):
    sf, lib = "/root/testdata/sf0.001", library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_byte_bpe(spark, sf).collect():
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs.pop(r.doc_id).encode()).hexdigest()
    assert not docs


def test_operators_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, " \t\n"), (4, "é ok " * 60_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    back = decode_ids(encode_texts(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in back), key=str) == sorted(((i, (t or "").encode()) for i, t in rows), key=str)
    got = round_trip(df, PATH, P.PATTERN).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows} and len(got) == 6
    assert round_trip(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0

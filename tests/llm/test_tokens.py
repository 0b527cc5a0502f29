import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from granary.llm.tokens import count_tokens, encoder, op5_token_counts, read_cache

SCHEMA = "doc_id long, text string, n_tokens string"


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: (len(r.text.encode()), n := len(t.encode(r.text, add_special_tokens=False).ids), n > 1024) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op5_token_counts(spark, sf).collect()} == want


def test_counts_by_piece_equal_library():
    rng, path = random.Random(7), P.path("byte_bpe_50k.json")
    t, alphabet = Tokenizer.from_file(path), "aeiou thnsr ETA éüñß 12 .,!'\n\t\x0b\x1c\x85\xa0\u200b日本 🙂'sll're"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(400)] + ["".join(rng.choices(" '.s\ntlve", k=80)) for _ in range(400)]
    texts += ["", "a<|endoftext|>b", "x" * 5000, " " * 3000, "'" * 50]
    assert encoder(path)(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_cache_and_odd_rows(spark, tmp_path, name):
    rows = [(1, None), (2, ""), (3, "a b  c"), (None, "a b  c"), (None, "alone"), (4, "<|endoftext|> x"), (5, "é" * 100_000), (3, "a b  c"), (3, "other")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    if name.endswith("json"):
        t = Tokenizer.from_file(P.path(name))
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        s = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        count = lambda x: len(s.encode(x))
    want = sorted(((i, len((x or "").encode()), count(x or "")) for i, x in rows), key=str)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = count_tokens(df, P.path(name), cache)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert read_cache(spark, cache).count() == 6 + 1  # (3, "a b  c") stands twice, so it is encoded twice
    assert count_tokens(spark.createDataFrame([], SCHEMA), P.path(name), cache).count() == 0

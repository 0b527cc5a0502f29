"""Hierarchical chunks by tokens."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granary.operators import sections
from granary.operators.sections import chunk_tree, hierarchical_chunks, sentence_pieces, token_spans

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def count():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_sentences_are_packed_by_their_tokens(count):
    text = "One two three. Four five. Six seven eight nine. Ten."
    pieces = sentence_pieces(text, 5, token_spans(PATH))
    assert "".join(p for p, _ in pieces) == text and [p for p, _ in pieces][:2] == ["One two three. ", "Four five. "]
    assert all(n == count(p) and n <= 5 for p, n in pieces)
    # budgets of 12 and 5 tokens, no overlap: three sentences fit a root, leaves hold one each
    tree = chunk_tree("d", "One two three.\nFour five.\nSix seven eight.\nTen.", (12, 5), 0, token_spans(PATH))
    roots, leaves = [t for t in tree if t[2] == "root"], [t for t in tree if t[2] == "leaf"]
    assert [r[5] for r in roots] == ["One two three.\nFour five.", "Six seven eight.\nTen."]
    assert [(t[5], t[1]) for t in leaves] == [("One two three.", roots[0][0]), ("Four five.", roots[0][0]), ("Six seven eight.", roots[1][0]), ("Ten.", roots[1][0])]


def test_long_sentences_are_cut_where_tokens_begin(count):
    for text in ("word " * 3000, "x" * 5000, "日本語のテキスト" * 200, "🙂" * 300, "áé" * 400, " " * 50 + "end"):
        pieces = sentence_pieces(text, 16, token_spans(PATH))
        assert "".join(p for p, _ in pieces) == text
        assert all(n == count(p) <= 16 or len(p) == 1 for p, n in pieces)
    assert sentence_pieces("", 16, token_spans(PATH)) == []


def test_documents_keep_their_budgets(spark, count):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 20_000)], "doc_id long, text string"))
    rows = hierarchical_chunks(docs, tokenizer=PATH).collect()
    by_id = {r.chunk_id: r for r in rows}
    budget = {"root": 2048, "parent": 512, "leaf": 128}
    assert all(count(r.text) <= budget[r.chunk_role] for r in rows)
    assert all(r.parent_id is None if r.chunk_role == "root" else r.text in by_id[r.parent_id].text for r in rows)
    long = [r for r in rows if r.doc_id == -3 and r.chunk_role == "leaf"]
    assert len(long) > 150 and not [r for r in rows if r.doc_id in (-1, -2)]
    # leaves overlap by up to 50 tokens inside a parent and hold all words between them
    assert sum(count(r.text) for r in long) >= 20_000


def test_counts_by_piece_give_the_same_chunks(spark, monkeypatch):
    """Texts of every kind; the library is asked for a repeated word once."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    docs += [None, "", "word " * 900, "x" * 900, "日本語。 のテ" * 40, "🙂é " * 90, "a <|endoftext|> b. c", "\t\n x \n\n y's don't 12 \x1c\x1d z\x85 ", "ǅ  a b. ß"]
    spans, counts = token_spans(PATH), sections.token_counts(PATH)
    for d in docs:
        assert chunk_tree("d", d, (256, 64, 16), 5, spans, counts) == chunk_tree("d", d, (256, 64, 16), 5, spans)
    texts = ["one two", " two"] * 50
    assert counts(texts) == [len(spans(t)) for t in texts]
    calls = []
    chunk_tree("d", "One two three. Four five.\n" * 20, (256, 64, 16), 5, lambda t: calls.append(t) or spans(t), counts)
    assert not calls  # spans are made of what is cut only

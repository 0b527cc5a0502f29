"""The pipeline's stages, one after the other, against plain versions of what each decides."""

import hashlib
import importlib.util
import os

import numpy as np
import public_tokenizers as P
import tiktoken
from test_exact import plain as plain_exact
from test_near_copies import plain_components

from granary.llm.bpe import read_ranks

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{ROOT}/corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in docs.collect()]
        ids = sorted(r["doc_id"] for r in after)
        seen.append(len(after))
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all(texts[r["doc_id"]] == r["text"] for r in after)
        if name == "language":
            gone = {r["doc_id"] for r in before} - set(ids)
            assert all(not any(c.isalpha() for c in texts[d]) for d in gone)
        elif name == "exact":
            assert ids == sorted(r[0] for r in plain_exact(list(texts.items())) if r[3])
        elif name == "near":
            groups, links = plain_components(texts)
            assert links and ids == sorted(d for d, c in groups.items() if d == c)
        elif name == "mix":
            assert set(ids) <= set(texts) and len(ids) > 0.8 * len(texts)
        elif name == "encode":
            lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            assert len(after) == len(before)
            for r in after:
                found = lib.encode_ordinary(texts_of[r["doc_id"]])
                assert r["n_tokens"] == len(found) and r["ids_sha256"] == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        texts_of = {r["doc_id"]: r["text"] for r in before} | {r["doc_id"]: r.get("text") for r in after if "text" in r}
    assert seen[1] < seen[0]


def test_stages_of_an_empty_table(spark):
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{ROOT}/corpus_pipeline.py")
    pipeline = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(pipeline)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

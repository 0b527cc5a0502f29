"""Toxicity by non-negative positive-unlabelled learning (nnPU)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches, materialise, shared_value, text_rows
from granary.llm.language import held_out

LETTERS = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5)


def text_words(text: str | None) -> set[str]:
    """The distinct words of a text, lower-cased."""
    return set(LETTERS.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """The words; marked by ^, the beginnings of those that are long enough; and by ^^, beginnings that two or more of
    the words share."""
    out = set(words)
    for k in BEGINNINGS:
        shared = Counter([w[:k] for w in words if len(w) >= k])
        out.update(map("^".__add__, shared), ["^^" + b for b, n in shared.items() if n > 1])
    return out


@dataclass
class WordModel:
    """A linear classifier over the features a text has; its score is the logistic of the sum."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text_words(text))
        z = self.bias + sum(map(self.weights.__getitem__, sorted(found & self.weights.keys())))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit_nnpu(positive: list[set[str]], unlabelled: list[set[str]], prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-4) -> WordModel:
    """Full-batch Adam on the non-negative PU risk with logistic loss, over texts given by their features:

        prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])

    Where the second term's estimate is below zero, the step instead undoes it (its gradient is reversed), so the
    unlabelled positives are not driven negative. Equal input gives an equal model. Without a positive or an unlabelled text the model has the prior's odds and no features."""
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return WordModel({}, bias)
    texts = positive + unlabelled
    vocabulary = sorted(set().union(*texts))
    place = {w: i for i, w in enumerate(vocabulary)}
    column = [sorted(map(place.__getitem__, words)) for words in texts]
    row = np.repeat(np.arange(len(texts)), [len(c) for c in column])
    column = np.array([i for c in column for i in c], np.int64)
    is_p = np.arange(len(texts)) < len(positive)
    in_p, in_u = is_p / len(positive), ~is_p / len(unlabelled)
    w, b = np.zeros(len(vocabulary) + 1), bias
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[column], len(texts)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        soft = np.logaddexp(0, z)
        negative = (in_u * soft).sum() - prior * (in_p * soft).sum()
        d_positive, d_negative = prior * in_p * (s - 1), in_u * s - prior * in_p * s
        d = d_positive + d_negative if negative >= 0 else -d_negative
        g = np.append(np.bincount(column, d[row], len(vocabulary)), d.sum())
        g[:-1] += decay * np.sign(w[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return WordModel({word: float(x) for word, x in zip(vocabulary, w) if abs(x) > 1e-3}, float(w[-1]))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_positive: int = 2000, max_unlabelled: int = 6000, least_docs: int = 5, least_z: float = 5.0, prior: float | None = None, labels_id_col: str | None = None) -> WordModel:
    """Fits the model on whole texts: up to max_positive documents that labels confirm as toxic, and up to
    max_unlabelled of all documents, whose labels are not looked at (those of the smallest xxhash64 of their ids). The
    class prior is the share of toxic among labelled documents, unless it is given. Features are those that least_docs texts of the sample
    have and whose shares in its two parts differ by at least least_z standard errors; Spark counts and selects them. Null ids, texts and labels teach
    nothing; a document that any label calls toxic is toxic. The sample's ids are broadcast and its texts' selected
    features reach the driver: both are bounded by the two sizes."""
    rows = text_rows(docs, id_col, text_col).where("doc_id is not null and text is not null")
    marks = labels.select(F.col(labels_id_col or id_col).alias("doc_id"), F.col(toxic_col).alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = rows.select("doc_id").join(marks, "doc_id", "left")
    counts = marked.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("p")).first()
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = first(marked.where("toxic = 1"), max_positive).withColumn("confirmed", F.lit(True)).unionByName(first(marked, max_unlabelled).withColumn("confirmed", F.lit(False)))
    texts = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "confirmed")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sorted(features(text_words(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "confirmed", "features"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    fitted = materialise(map_batches(texts, make, f"doc_id {kind}, confirmed boolean, features array<string>"), "toxicity-sample")
    sizes = fitted.agg(F.count_if("confirmed").alias("m"), F.count_if(~F.col("confirmed")).alias("n")).first()
    if prior is None:
        prior = (counts["p"] or 0) / max(counts["n"] or 0, 1)
    if not sizes.m or not sizes.n:
        return fit_nnpu([], [], prior)
    flat = fitted.select("doc_id", "confirmed", F.explode("features").alias("feature"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / (sizes.m + sizes.n)
    error = F.sqrt(share * (1 - share) * (1 / sizes.m + 1 / sizes.n))
    told = flat.groupBy("feature").agg(F.count_if("confirmed").alias("a"), F.count_if(~F.col("confirmed")).alias("b"))
    told = told.where((a + b >= least_docs) & (F.abs(a / sizes.m - b / sizes.n) >= least_z * error)).select("feature")
    kept = flat.join(told, "feature").groupBy("doc_id", "confirmed").agg(F.collect_set("feature").alias("kept"))
    found = fitted.select("doc_id", "confirmed").join(kept, ["doc_id", "confirmed"], "left").toPandas().sort_values("doc_id", kind="stable")
    sides = [[set(x if x is not None else ()) for x in found["kept"][found["confirmed"] == side]] for side in (True, False)]
    return fit_nnpu(*sides, prior=prior)


def score_toxicity(docs: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row's whole text, however long.

    Null and empty texts get the score of no words. Repeated rows and null ids give a row each, an empty table none;
    other columns are not read."""
    shared = shared_value(docs.sparkSession, WordModel, model.weights, model.bias)

    def make():
        own = shared()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.array([own.score(t) for t in batch.column(1).to_pylist()], np.float64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, score double, predicted int")


def op4_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_toxicity(docs.where(~held_out(5, 0)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")

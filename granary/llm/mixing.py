"""Mixing sources to target weights: temperature, bisection, budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import documents, materialise

#: Bits of a block's place in a permutation by which blocks are grouped, so that no window sees all of a source's.
GROUP_BITS = 12


@dataclass
class Weights:
    """Exponent and normalised weights, by source in the order of `sources`."""

    sources: list[str]
    exponent: float
    weights: np.ndarray


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def temperature_weights(sources: list[str], tokens: list[int], budget: float, target_entropy: float | None = None, most_repeats: float | None = None, steps: int = 60) -> Weights:
    """Weights proportional to token share to the power a, with a in [0, 1] bisected.

    The smaller a, the more even the weights and the more often small sources repeat. a is the largest with an
    entropy of at least target_entropy, raised as far as needed for budget * weight <= most_repeats * tokens in every
    source; a = 1 (natural shares) where even that can't be met, a = 0 where the entropy is never reached. Sources
    without tokens get weight 0."""
    n = np.array(tokens, np.float64)
    share = n / n.sum() if n.sum() else n

    def at(a: float) -> np.ndarray:
        w = np.where(share > 0, np.power(np.where(share > 0, share, 1), a), 0)
        return w / w.sum() if w.sum() else w

    def bisect(holds_above) -> float:
        """The smallest a in [0, 1] from which on holds_above is true."""
        low, high = 0.0, 1.0
        if holds_above(low):
            return low
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if holds_above(mid) else (mid, high)
        return high

    a = 1.0
    if target_entropy is not None and entropy(at(1.0)) < target_entropy:
        a = bisect(lambda x: entropy(at(x)) <= target_entropy)
    if most_repeats is not None:
        fits = lambda x: bool((at(x) * budget <= most_repeats * n * (1 + 1e-12)).all())
        if not fits(a):
            a = max(a, bisect(fits))
    return Weights(sources, a, at(a))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_sources(docs: DataFrame, budget: float | None = None, entropy_share: float = 0.9, most_repeats: float = 4.0, seed: int = 0, block_tokens: int = 100_000, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """The mixed stream's documents: doc_id, source, epoch, block, place, n_tokens, weight; a row for each time a
    document is used. Sorting by (epoch, block, place) within a source gives its order.

    budget is in tokens (words, if no other count is given), all tokens by default. Weights are temperature_weights for an entropy
    of entropy_share of the most that the sources allow. A source's quota is weight * budget. It is met by epochs:
    each deals the source's documents to hashed blocks, permutes the blocks, and permutes documents within blocks; the
    last epoch takes whole blocks while they fit the quota, and of the next block the documents that still do. So a
    quota is missed by less than a document, and the budget is never exceeded.

    Only totals by source reach the driver. Running sums go over groups of blocks (4,096 a source and epoch), over one
    group's blocks and over one block's documents, never over a source. Null and empty sources are one source named
    ''. Documents without tokens come along with their block. Sources without tokens and rows with a null doc_id are
    not used. Rows that repeat a doc_id are documents of their own, ordered by their tokens; those that are equal in
    that too are alike in the result. An empty table gives no rows."""
    count = tokens if tokens is not None else word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), count.cast("long").alias("n_tokens")).where("doc_id is not null")
    rows = materialise(rows.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long"))), "mix-rows")
    spark = docs.sparkSession
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("total")).orderBy("source").collect()
    named, sizes = [r.source for r in totals], [r.total for r in totals]
    budget = float(sum(sizes)) if budget is None else float(budget)
    goal = entropy_share * float(np.log(max(1, sum(s > 0 for s in sizes))))
    mix = temperature_weights(named, sizes, budget, goal, most_repeats)
    plan = [(s, float(w), int(t), int(w * budget // t), float(w * budget % t), max(1, -(-int(t) // block_tokens))) for s, w, t in zip(named, mix.weights, sizes) if t > 0]
    plan = spark.createDataFrame(plan, "source string, weight double, total long, full_epochs int, rest double, n_blocks long")
    hashed = lambda *x: F.xxhash64(*x, F.lit(seed))
    dealt = rows.join(F.broadcast(plan), "source").withColumn("block_id", F.pmod(hashed("doc_id"), F.col("n_blocks")))

    blocks = dealt.groupBy("source", "block_id").agg(F.sum("n_tokens").alias("block_tokens")).join(F.broadcast(plan), "source")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full_epochs"))))
    # a block's place is its hash's: groups of it are summed first, so that its own window sees one group
    blocks = blocks.withColumn("hash", hashed("block_id", "epoch")).withColumn("part", F.shiftright("hash", 64 - GROUP_BITS))
    parts = blocks.groupBy("source", "epoch", "part").agg(F.count("*").alias("part_blocks"), F.sum("block_tokens").alias("part_tokens"))
    ahead = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("source", "epoch", "part", (F.sum("part_blocks").over(ahead) - F.col("part_blocks")).alias("blocks_ahead"), (F.sum("part_tokens").over(ahead) - F.col("part_tokens")).alias("tokens_ahead"))
    order = Window.partitionBy("source", "epoch", "part").orderBy("hash", "block_id")
    blocks = blocks.join(parts, ["source", "epoch", "part"]).withColumn("block", F.row_number().over(order) - 1 + F.col("blocks_ahead"))
    blocks = blocks.withColumn("before", F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_tokens") + F.col("tokens_ahead"))
    last = F.col("epoch") == F.col("full_epochs")
    left = F.when(last, F.col("rest") - F.col("before"))  # tokens that the block may still give
    blocks = blocks.where(~last | (left > 0)).select("source", "block_id", "epoch", "block", F.when(last & (left < F.col("block_tokens")), left).alias("left"))

    used = dealt.select("doc_id", "source", "n_tokens", "weight", "block_id").join(blocks, ["source", "block_id"])
    inside = Window.partitionBy("source", "block_id", "epoch").orderBy(hashed("doc_id", "epoch"), "doc_id", "n_tokens")
    used = used.withColumn("place", F.row_number().over(inside) - 1).withColumn("through", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where("left is null or through <= left").select("doc_id", "source", "epoch", "block", "place", "n_tokens", "weight")


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))

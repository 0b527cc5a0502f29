"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches, shared_value, text_rows

ORDER = 3
#: What stands before a text, so that its first bytes have a context.
START = b"\n" * ORDER
#: Bytes that are scored at a time.
CHUNK = 1 << 20
UNKNOWN = "und"


@dataclass
class ContextTrees:
    """Frozen statistics of all languages: one variable-order context tree as an automaton of two table look-ups.

    The state after bytes x, y, z is the longest suffix that the tree has: third[second[y, z], x]. cost[state, byte]
    holds the code length in bits of that byte under each language."""

    langs: list[str]
    second: np.ndarray
    third: np.ndarray
    cost: np.ndarray
    typical: np.ndarray  # bits a byte that each language's model takes for its own texts

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language's model takes to code each whole text; (texts, languages)."""
        total = np.zeros((len(texts), len(self.langs)))
        pieces, held = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                before = text[at - ORDER : at] if at else START
                pieces.append((i, before + text[at : at + CHUNK]))
                held += len(pieces[-1][1])
                if held >= CHUNK:
                    self._add(total, pieces)
                    pieces, held = [], 0
        if pieces:
            self._add(total, pieces)
        return total

    def _add(self, total: np.ndarray, pieces: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).astype(np.int32)
        state = self.third[self.second[data[1:-2] << 8 | data[2:-1]] << 8 | data[:-3]]
        bits = self.cost[state << 8 | data[3:]]
        sizes = np.array([len(p) for _, p in pieces])
        ends = np.cumsum(sizes)
        for lag in range(1, ORDER):  # positions that straddle two pieces; the first piece's are not in bits
            bits[ends[:-1] - lag] = 0
        bits[ends[:-1] - ORDER] = 0
        starts = ends - sizes
        owner = [i for i, _ in pieces]
        np.add.at(total, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))


def _rows(contexts: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Each context's distribution over bytes: PPM with escape method C, exclusion by renormalising the lower order.

    A context that a language never saw leaves its row as the lower order has it."""
    seen = np.zeros((len(contexts), 256))
    at = np.searchsorted(contexts, context)
    np.add.at(seen, (at, symbol), count)
    n, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
    free = np.where(seen > 0, 0, lower)
    rest = free.sum(1, keepdims=True)
    escape = np.where(rest > 0, kinds / np.maximum(n + kinds, 1), 0)
    known = seen / np.maximum(np.where(rest > 0, n + kinds, n), 1)
    return np.where(n > 0, known + escape * free / np.maximum(rest, 1e-300), lower)


def build_trees(counts: dict[str, tuple[np.ndarray, np.ndarray]], least_count: int) -> ContextTrees:
    """Context trees from each language's counts of 4-byte strings (packed big-endian).

    A context becomes a node where some language saw it least_count times; elsewhere its longest kept suffix serves."""
    langs = sorted(counts)
    kept: list[np.ndarray] = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        found = set()
        for grams, n in counts.values():
            context, at = np.unique(grams >> 8 & (1 << 8 * k) - 1, return_inverse=True)
            found.update(context[np.bincount(at, n) >= least_count].tolist())
        kept.append(np.array(sorted(found), np.int64))
    base = np.cumsum([0, *map(len, kept)])
    cost = np.empty((base[-1], 256, len(langs)), np.float32)
    suffix = [np.zeros(1, np.int64)]  # of each order's contexts: the row of its suffix one order below
    for k in range(1, ORDER + 1):
        short = kept[k] & (1 << 8 * (k - 1)) - 1
        suffix.append(np.searchsorted(kept[k - 1], short))  # a kept context's suffix is seen as often, so kept too
    for j, lang in enumerate(langs):
        grams, n = counts[lang]
        rows = np.full((1, 256), 1 / 256)
        for k in range(ORDER + 1):
            context, symbol = grams >> 8 & (1 << 8 * k) - 1, grams & 255
            if k:
                inside = np.isin(context, kept[k])
                context, symbol, count = context[inside], symbol[inside], n[inside]
            else:
                count = n
            rows = _rows(kept[k], context, symbol, count, rows[suffix[k]])
            cost[base[k] : base[k + 1], :, j] = -np.log2(rows)
    # second: (y, z) -> row of third; a row for each kept pair, then one for each last byte whose pair is not kept
    one = np.full(256, 0)
    one[kept[1]] = base[1] + np.arange(len(kept[1]))
    second = len(kept[2]) + (np.arange(1 << 16) & 255)
    second[kept[2]] = np.arange(len(kept[2]))
    third = np.concatenate([np.repeat(base[2] + np.arange(len(kept[2])), 256), np.repeat(one, 256)])
    row = second[kept[3] & 0xFFFF]
    third[row << 8 | kept[3] >> 16] = base[3] + np.arange(len(kept[3]))
    cost = cost.reshape(len(cost) * 256, len(langs))
    typical = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        grams, n = counts[lang]
        state = third[second[grams >> 8 & 0xFFFF] << 8 | grams >> 24]
        typical[j] = (cost[state << 8 | grams & 255, j] * n).sum() / max(n.sum(), 1)
    return ContextTrees(langs, second.astype(np.int32), third.astype(np.int32), cost, typical)


def train_language_trees(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", docs_per_lang: int = 1000, least_count: int = 24) -> ContextTrees:
    """Fits the trees on whole texts of at most docs_per_lang documents of each language, those of the smallest
    xxhash64 of their ids. Rows with a null language, id or text teach nothing. The sample's ids (16 bytes each, a
    bounded number a language) are broadcast, and only counts of 4-byte strings of the sample reach the driver."""
    rows = text_rows(docs, id_col, text_col, F.col(lang_col).alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    sample = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("order"))
    for part in (["lang", F.pmod("order", F.lit(64))], ["lang"]):  # a hot language is ranked in 64 parts, then what they leave
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("order", "doc_id"))
        sample = sample.withColumn("rank", rank).where(F.col("rank") <= docs_per_lang).drop("rank")
    sample = sample.select("doc_id", "lang")
    texts = rows.join(F.broadcast(sample), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(text.encode())
            out = [], [], []
            for lang, parts in by.items():
                grams = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(START + p, np.uint8), ORDER + 1) for p in parts if p]
                if not grams:
                    continue
                packed = np.concatenate([g[:, 0].astype(np.int64) << 24 | g[:, 1].astype(np.int64) << 16 | g[:, 2].astype(np.int64) << 8 | g[:, 3] for g in grams])
                values, n = np.unique(packed, return_counts=True)
                out[0].extend([lang] * len(values))
                out[1].append(values)
                out[2].append(n)
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), join(out[1]), join(out[2])], ["lang", "gram", "n"])

        return step

    found = map_batches(texts, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in found.groupby("lang")}
    return build_trees(counts, least_count)


def _named(trees: ContextTrees, texts: list[str | None]) -> tuple[list[int], list[int], np.ndarray]:
    """Which texts have a letter and trees to be scored by, their UTF-8 sizes, and their code lengths."""
    at = [i for i, t in enumerate(texts) if trees.langs and t and any(map(str.isalpha, t))]
    data = [texts[i].encode() for i in at]
    return at, [len(d) for d in data], trees.code_lengths(data)


def predict_languages(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for each row, from its whole text alone.

    lang_pred is the language whose model gives the shortest code (ties: the first by name), score its share when
    code lengths are read as log likelihoods. und, 0 and null for a null text, one without a letter, or trees that
    learned no language. Very long texts are scored in chunks that carry their contexts along. Repeated rows and null
    ids give a row each, an empty table none; other columns are not read."""
    model = shared_value(docs.sparkSession, ContextTrees, trees.langs, trees.second, trees.third, trees.cost, trees.typical)

    def make():
        own = model()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            lang, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            at, sizes, bits = _named(own, texts)
            best = bits.argmin(1) if at else []
            for k, i in enumerate(at):
                lang[i] = own.langs[best[k]]
                score[i] = float(1 / np.exp2(np.maximum(bits[k, best[k]] - bits[k], -1000)).sum())
                rate[i] = float(bits[k, best[k]] / sizes[k])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def known_language(docs: DataFrame, trees: ContextTrees, text_col: str = "text", most: float = 2.0, allowance: float = 512.0) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language; nothing is shuffled.

    A text is when one of the models codes it in at most `most` times the bits a byte that it takes for its own
    language, plus `allowance` bits for what any document may hold beside prose: an address, a number, a key of some
    40 bytes. So a foreign text or junk is told from about 100 bytes on; shorter ones stay. Null texts and texts
    without a letter go. Where the trees have learned no language every text goes."""
    model = shared_value(docs.sparkSession, ContextTrees, trees.langs, trees.second, trees.third, trees.cost, trees.typical)
    place = docs.columns.index(text_col)

    def make():
        own = model()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, sizes, bits = _named(own, batch.column(place).to_pylist())
            keep = np.zeros(batch.num_rows, bool)
            if at:
                keep[at] = (bits <= most * own.typical * np.array(sizes)[:, None] + allowance).any(1)
            return batch.filter(pa.array(keep))

        return step

    return map_batches(docs, make, docs.schema)


def held_out(mod: int, remainder: int):
    """Whether crc32 of doc_id as text leaves that remainder; a null doc_id is hashed as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == remainder


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = train_language_trees(docs.where(~held_out(4, 2)))
    return predict_languages(docs, trees).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")

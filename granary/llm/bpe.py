"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from granary.llm.common import documents, map_batches, shared_value, spans_of, text_rows

#: Rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)
#: Rows up to this many bytes merge one pair a round; in wider ones all pairs of the minimum rank merge at once.
WIDE = 256
#: Pieces whose ids a worker remembers, and characters it splits at a time.
REMEMBERED, CHARS = 300_000, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class PairTable:
    """Rank of the merge of two ids: open addressing with linear probing, looked up for whole arrays at once."""

    keys: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def build(ranks: dict[bytes, int]) -> PairTable:
        """All splits of a token into two tokens."""
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        size = 1 << max(4, (2 * len(pairs)).bit_length())
        keys, values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo = np.array([p[0] for p in pairs], np.int64)
        rank = np.array([p[1] for p in pairs], np.int32)
        slot = _slots(todo, size)
        while len(todo):
            free = keys[slot] == -1
            keys[slot[free]] = todo[free]  # of several for one slot, the last stays; the others go on
            got = keys[slot] == todo
            values[slot[got]] = rank[got]
            todo, rank, slot = todo[~got], rank[~got], slot[~got] + 1 & size - 1
        return PairTable(keys, values)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where two ids don't merge or one is padding (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = _slots(key, len(self.keys))
        found = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot, key = slot[todo], key[todo]
        while len(todo):
            at = self.keys[slot]
            hit = at == key
            found[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at != -1)
            todo, slot, key = todo[on], slot[on] + 1 & len(self.keys) - 1, key[on]
        return found


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - size.bit_length())).astype(np.int64)


@dataclass
class ByteBpe:
    """A vocabulary of ranks with its merges; encodes and decodes without special tokens."""

    ranks: dict[bytes, int]
    pattern: str
    table: PairTable
    cache: dict[str, bytes] = field(default_factory=dict)

    @staticmethod
    def load(path: str, pattern: str) -> ByteBpe:
        ranks = read_ranks(path)
        return ByteBpe(ranks, pattern, PairTable.build(ranks))

    def __post_init__(self):
        self.split = regex.compile(self.pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        # of tokens that take part in a merge of a smaller rank than their own, one pair merges at a time
        used = self.table.keys[self.table.keys >= 0]
        rank = self.table.ranks[self.table.keys >= 0]
        parts = np.concatenate([used >> 32, used & 0xFFFFFFFF])
        self.alone = np.zeros(max(self.ranks.values()) + 1, bool)
        self.alone[parts[parts > np.concatenate([rank, rank])]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in spans_of([len(t) for t in texts], CHARS):
            pieces = [self.split(t) for t in texts[a:b]]
            if len(self.cache) > REMEMBERED:
                self.cache.clear()
            new = list(set().union(*pieces).difference(self.cache))
            self.cache.update(zip(new, self._merge_all([p.encode() for p in new])))
            out += [b"".join(map(self.cache.__getitem__, p)) for p in pieces]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as encode() gives them."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                step = 4 if len(piece) <= WIDE else 1 << len(piece).bit_length() - 3
                buckets.setdefault(-(-len(piece) // step) * step, []).append(i)
        for width, rows in buckets.items():
            most = max(1, (1 << 20) // width)
            merge = self._merge_matrix if width <= WIDE else self._merge_wide
            for at in range(0, len(rows), most):
                for i, ids in zip(rows[at : at + most], merge([pieces[i] for i in rows[at : at + most]], width)):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """A row a piece, padded with -1. Each round, every row merges its leftmost pair of minimum rank and moves
        what is right of it up by one; rows without a pair left are done and leave the matrix."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        final, length, row = np.full_like(ids, -1), sizes.copy(), np.arange(len(pieces))
        column = np.arange(width)
        while len(row):
            best = rank.argmin(1)
            low = rank[np.arange(len(row)), best]
            done = low == NONE
            if done.any():
                final[row[done], : ids.shape[1]] = ids[done]
                ids, rank, row, best, low = ids[~done], rank[~done], row[~done], best[~done], low[~done]
                if not len(row):
                    break
                if (widest := length[row].max()) < ids.shape[1]:  # columns that only padding is left in
                    ids, rank = ids[:, :widest], rank[:, : widest - 1]
            each, last = np.arange(len(row)), ids.shape[1] - 1
            ids[each, best] = low
            source = np.minimum(column[:last] + (column[:last] > best[:, None]), last)
            moved = np.take_along_axis(ids, source, 1)
            moved_rank = np.full((len(row), max(last - 1, 0)), NONE, np.int32)
            if last > 1:
                moved_rank[:] = np.take_along_axis(rank, np.minimum(source[:, :-1], last - 1), 1)
                for side in (-1, 0):  # only the pairs that the merged id is in have changed
                    at = best + side
                    ok = (at >= 0) & (at < last - 1)
                    moved_rank[each[ok], at[ok]] = self.table.look_up(moved[each[ok], at[ok]], moved[each[ok], at[ok] + 1])
            else:
                moved_rank = np.full((len(row), 1), NONE, np.int32)
                moved = np.concatenate([moved, np.full((len(row), 1), -1, np.int32)], 1)
            ids, rank = moved, moved_rank
            length[row] -= 1
        flat = final[final >= 0].astype("<u4").tobytes()
        ends = np.cumsum(length) * 4
        return [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), length.tolist())]

    def _merge_wide(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The same merges over the same kind of matrix, for long rows: each round merges all pairs of the row's minimum
        rank, from the left and without overlap, where that equals merging the leftmost again and again. It does when
        no merge that the new token takes part in has a smaller rank: then what the merge puts beside the other pairs
        never goes before them. Rows whose new token is otherwise merge the leftmost pair alone."""
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        out, row = [b""] * len(pieces), np.arange(len(pieces))
        while len(row):
            low = rank.min(1) if rank.shape[1] else np.full(len(row), NONE, np.int32)
            for i in np.flatnonzero(low == NONE):
                out[row[i]] = ids[i][ids[i] >= 0].astype("<u4").tobytes()
            ids, rank, row, low = (x[low != NONE] for x in (ids, rank, row, low))
            if not len(row):
                break
            hit = rank == low[:, None]
            column = np.arange(hit.shape[1])
            begins = hit.copy()
            begins[:, 1:] &= ~hit[:, :-1]
            since = column - np.maximum.accumulate(np.where(begins, column, 0), axis=1)
            take = hit & (since % 2 == 0)
            single = self.alone[low]
            take[single] &= column == hit[single].argmax(1)[:, None]
            new = np.zeros(ids.shape, bool)
            new[:, :-1] = take
            kept = ids >= 0
            kept[:, 1:] &= ~take
            ids = np.where(new, low[:, None], ids)
            length = kept.sum(1)
            place = np.arange(length.max()) < length[:, None]
            pair = np.full(ids.shape, NONE, np.int32)
            pair[:, :-1] = rank
            moved, fresh, ranks = np.full(place.shape, -1, np.int32), np.zeros(place.shape, bool), np.full(place.shape, NONE, np.int32)
            moved[place], fresh[place], ranks[place] = ids[kept], new[kept], pair[kept]
            ids, rank = moved, ranks[:, :-1]
            changed = fresh[:, :-1] | fresh[:, 1:]  # only pairs that a new token is in have other ranks
            rank[changed] = self.table.look_up(ids[:, :-1][changed], ids[:, 1:][changed])
        return out


def _shared(spark: SparkSession, ranks: str, pattern: str):
    own = ByteBpe.load(ranks, pattern)
    return shared_value(spark, lambda *p: ByteBpe(p[0], p[1], PairTable(p[2], p[3])), own.ranks, pattern, own.table.keys, own.table.ranks)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each row's whole text by the ranks file at that path; no ids for null or empty.

    Repeated rows and null doc_ids give a row each, an empty table none; other columns are not read."""
    shared = _shared(docs.sparkSession, ranks, pattern)

    def make():
        own = shared()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = own.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(d) // 4 for d in data)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), "<i4")))
            return pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary): the bytes of each row's ids; null ids give no bytes. An unknown id is an error.

    Repeated rows and null doc_ids give a row each, an empty table none; other columns are not read."""
    shared = _shared(encoded.sparkSession, ranks, pattern)

    def make():
        own = shared()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "decoded"])

        return step

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(encoded, id_col, ids_col), make, f"doc_id {kind}, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each row's whole text and decodes the ids, in one pass.

    Null counts as empty: no ids, no bytes. Repeated rows and null ids give a row each, an empty table none."""
    shared = _shared(docs.sparkSession, ranks, pattern)

    def make():
        own, sha = shared(), hashlib.sha256

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, decoded_sha = [], [], []
            for a, b in spans_of([len(t) for t in texts], CHARS):
                for ids in own.encode(texts[a:b]):
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids).hexdigest())
                    decoded_sha.append(sha(own.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

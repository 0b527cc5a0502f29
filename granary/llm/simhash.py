"""SimHash near-duplicates: pivot distance tables find the pairs of close fingerprints."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, documents, gram_hashes, if_small, map_batches, materialise, mixed, text_rows, word_hashes
from granary.llm.components import components

BITS = 64
#: Reference fingerprints: XXH64 of their numbers, so that every job uses the same ones.
PIVOTS = 16


def fingerprint_bits(text: bytes, shingle_words: int) -> int:
    """64-bit SimHash of a text: a bit is 1 where more than half of the shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))) if len(words) >= shingle_words else [b" ".join(words)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    n = len(hashes)
    lanes = np.unpackbits(hashes, axis=1).view(np.uint64)  # eight counters of one byte each; 255 rows can't overflow them
    ones = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp long): the SimHash of each row's whole text; 0 for a null or wordless text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint_bits((t or "").encode(), shingle_words) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pivot(j: int) -> int:
    return xxhash.xxh64_intdigest(f"pivot {j}".encode(), 42)


def _block_masks(blocks: int) -> list[int]:
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _distance(fp: Column, j: int, mask: int = (1 << 64) - 1) -> Column:
    """Hamming distance of fp to reference fingerprint j, over the bits of mask."""
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(_pivot(j)))).bitwiseAND(F.lit(_signed(mask)))).cast("long")


def _packed(parts: list[Column], width: int) -> Column:
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(p, width * i) for i, p in enumerate(parts)))


def pivot_table(fps: DataFrame, blocks: int) -> DataFrame:
    """(fp, near_1, near_2, block_0 ...): each fingerprint's distances to all reference fingerprints.

    near_1 and near_2 hold the sixteen distances over all bits, a byte each; block_b holds the same distances over
    the bits of block b, four bits each (a block of at least 5 in 64 bits has at most 13). Blocks add up to the whole."""
    fp = F.col("fp")
    half = PIVOTS // 2
    near = [_packed([_distance(fp, j) for j in range(i * half, (i + 1) * half)], 8) for i in range(2)]
    parts = [_packed([_distance(fp, j, mask) for j in range(PIVOTS)], 4) for mask in _block_masks(blocks)]
    return fps.select("fp", near[0].alias("near_1"), near[1].alias("near_2"), *(p.alias(f"block_{b}") for b, p in enumerate(parts)))


def close_pairs(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp_a, fp_b): all pairs of distinct fingerprints (column fp, unique) that differ in at most radius bits.

    By the triangle inequality a close pair's distances to any reference fingerprint differ by at most radius, and
    so does the sum over blocks of their largest differences: at least blocks - radius blocks have equal pivot
    distances throughout. Pairs meet on those equal rows of the pivot table, one equi-join for every choice of
    blocks; pairs whose whole distances differ by more than radius in any coordinate are discarded; what survives is
    verified bit by bit. No link can be missed. Every fingerprint is sent C(blocks, radius) times. More blocks give
    longer keys, hence fewer chance meetings in larger collections: with 5, keys have about 25 bits."""
    if not 5 <= blocks or not 0 <= radius < blocks:
        raise ValueError("blocks must be at least 5 and more than radius")
    table = pivot_table(fps, blocks)
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(*(F.col(f"block_{b}") for b in kept)).alias("key")) for t, kept in enumerate(combinations(range(blocks), blocks - radius))]
    rows = table.select("fp", "near_1", "near_2", F.explode(F.array(*keys)).alias("at")).select("at.t", "at.key", "fp", "near_1", "near_2")
    a, b = rows.alias("a"), rows.alias("b")
    near = reduce(
        lambda x, y: x & y,
        (F.abs(F.shiftright(F.col(f"a.near_{n}"), 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(F.col(f"b.near_{n}"), 8 * i).bitwiseAND(F.lit(255))) <= radius for n in (1, 2) for i in range(PIVOTS // 2)),
    )
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    return met.where(near).where(close).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per input row: doc_id, fp long, component_id (smallest doc_id that links reach) and n_links.

    blocks is chosen from the number of distinct fingerprints unless it is given, so that chance meetings stay in
    proportion to them.
    Equal fingerprints are one class, represented by its smallest doc_id, so copies cost no pairs; n_links counts the
    other fingerprints within radius of the row's own. Null and wordless texts have fingerprint 0 and link like any
    other. A row with a null doc_id gets its class's component. Repeated rows each give a row. An empty table gives
    an empty result. Other columns of docs are not read."""
    each = materialise(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "simhash-classes")
    if blocks is None:  # for radius 3 keys have 25, 32, 36 and 40 bits at 5, 6, 7 and 8 blocks
        count = classes.count()
        blocks = max(radius + 2, 5 + sum(count > 1 << b for b in (27, 34, 38)))
    pairs = materialise(close_pairs(classes.select("fp"), radius, blocks), "simhash-pairs")
    both = pairs.unionByName(pairs.select(F.col("fp_b").alias("fp_a"), F.col("fp_a").alias("fp_b")))
    degree = both.groupBy("fp_a").agg(F.count("*").alias("n_links")).withColumnRenamed("fp_a", "fp")
    linked = pairs.join(classes.select(F.col("fp").alias("fp_a"), F.col("rep").alias("a")), "fp_a").join(classes.select(F.col("fp").alias("fp_b"), F.col("rep").alias("b")), "fp_b").select("a", "b").where("a is not null and b is not null")
    labels = components(linked)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "fp", "left")
    named = named.select("fp", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return each.join(named, "fp").select("doc_id", "fp", "component_id", "n_links")


#: Bits of a wide fingerprint, bits of a search key, and reference fingerprints of the wide pivot table.
WIDE, KEY, WIDE_PIVOTS = 128, 32, 8
#: Rows that each row is compared with on either side in a table's order, and candidates of each that come first.
BESIDE, FIRST = 8, 3
#: Most rows of a cell whose pairs are compared one by one; most sets that a rare shingle is in; size bands to a factor of e.
FEW, RARE, BANDS = 64, 16, 20


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; a shorter text with a word is one shingle."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(shingle_words, len(words)), len(words) if len(words) < shingle_words else 0))


def wide_bits(shingles: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set of shingles, as bits: 1 where more than half of the hashes have it."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        both = np.stack([part, mixed(part ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
        lanes = np.unpackbits(both.view(np.uint8), axis=1).view(np.uint64)  # counters of one byte each, 255 rows at most
        ones += np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return (2 * ones > len(shingles)).astype(np.uint8)


def sketches(rows: DataFrame, shingle_words: int, tables: int) -> DataFrame:
    """(doc_id, digest, n, fp_1, fp_2, keys) of rows (doc_id, text): a digest of the set of shingles, its size, its wide
    fingerprint, and for each table a key of 32 of the fingerprint's bits in an order of the table's own."""

    def make():
        chosen = np.stack([np.random.default_rng(t).permutation(WIDE)[:KEY] for t in range(tables)])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle_words) for t in batch.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            bits = np.stack([wide_bits(s) for s in sets]) if sets else np.zeros((0, WIDE), np.uint8)
            halves = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
            keys = np.packbits(bits[:, chosen], axis=2).view(">i4").astype(np.int32).ravel()
            ends = np.arange(len(sets) + 1, dtype=np.int32) * tables
            columns = [digests, pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "digest", "n", "fp_1", "fp_2", "keys"])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, digest binary, n long, fp_1 long, fp_2 long, keys array<int>")


def _table_rows(fps: DataFrame, tables: int, bits: int, more: list[Column] = []) -> DataFrame:  # noqa: B006
    """Rows of sketches() with a label, once a table: their pivot distances, the table, its key and the key's first bits."""
    wide = lambda j: [F.bit_count(F.col(f"fp_{i}").bitwiseXOR(F.lit(_signed(_pivot(2 * j + i))))).cast("long") for i in (1, 2)]
    pivots = _packed([sum(wide(j)) for j in range(WIDE_PIVOTS)], 8)
    rows = fps.select("doc_id", "label", *more, "n", "fp_1", "fp_2", pivots.alias("near"), F.posexplode(F.slice("keys", 1, tables)).alias("t", "key"))
    return rows.withColumn("part", F.shiftrightunsigned("key", KEY - bits))


def _close(a: str, b: str, similarity: float, radius: int) -> tuple[Column, Column]:
    """Whether rows with prefixes a and b may be that similar, and in how many bits they differ.

    Pairs whose distances to a reference fingerprint differ by more than radius are discarded by the pivot table; the
    others are verified bit by bit."""
    at = lambda c, i: F.shiftright(F.col(f"{c}near"), 8 * i).bitwiseAND(F.lit(255))
    near = reduce(lambda x, y: x & y, (F.abs(at(a, i) - at(b, i)) <= radius for i in range(WIDE_PIVOTS)))
    distance = sum(F.bit_count(F.col(f"{a}fp_{i}").bitwiseXOR(F.col(f"{b}fp_{i}"))) for i in (1, 2))
    sized = F.least(f"{a}n", f"{b}n") >= similarity * F.greatest(f"{a}n", f"{b}n") - 1e-9
    return near & (distance <= radius) & sized, distance


def wide_candidates(fps: DataFrame, count: int, similarity: float, radius: int, tables: int, bits: int) -> DataFrame:
    """(a, b, distance, apart): pairs of rows of sketches(), with a column `label` each, that lie side by side in one of
    the first tables, have different labels, differ in at most radius bits, and have sizes that allow the similarity.
    apart: they met only where they don't share the first `bits` of the key.

    A table sorts rows by its key and compares each with BESIDE rows before it, so the work is in proportion to the
    rows, also inside a large group of near copies. Pairs that share a key's first bits further apart are left to
    cell_links."""
    rows = _table_rows(fps, tables, min(20, max(4, count.bit_length() - 12)))  # some 4,096 rows: fewer bits than side by side rows share
    rows = rows.withColumn("cell", F.shiftrightunsigned("key", KEY - bits))
    order = Window.partitionBy("t", "part").orderBy("key", "doc_id")
    own = ["doc_id", "label", "n", "fp_1", "fp_2", "near", "cell"]
    here = F.struct(*own)
    met = rows.select(*own, *(F.lag(here, i).over(order).alias(f"before_{i}") for i in range(1, BESIDE + 1)))
    met = met.select(*own, F.explode(F.array(*(f"before_{i}" for i in range(1, BESIDE + 1)))).alias("o")).where("o is not null and label <> o.label")
    close, distance = _close("", "o.", similarity, radius)
    met = met.where(close).select(F.least("doc_id", "o.doc_id").alias("a"), F.greatest("doc_id", "o.doc_id").alias("b"), distance.alias("distance"), (F.col("cell") != F.col("o.cell")).alias("apart"))
    return met.groupBy("a", "b").agg(F.min("distance").alias("distance"), F.min("apart").alias("apart"))


def _closest(pairs: DataFrame) -> DataFrame:
    """(a, b): of pairs (a, b, distance), those that are among the FIRST closest of either row."""
    both = pairs.select("a", "b", "distance").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    closest = both.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("place") <= FIRST)
    return closest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cell_links(rows: DataFrame, firsts: DataFrame, links: DataFrame, shingle_words: int, similarity: float, radius: int, tables: int, bits: int) -> DataFrame:
    """links and those between rows of sketches() that share the first `bits` of a table's key and differ in at most
    radius bits, except between rows that others join. rows (doc_id, text) gives the texts.

    No cell is capped. In cells of at most FEW rows all pairs of different components are compared. Of larger cells' rows
    the shingles are counted: first each row meets the row of a cell that has the largest share of common ones, which
    joins most of a large group by FIRST links a row; then a pair is made only if it shares a rare shingle (rare_pairs) or
    has enough common ones (common_pairs). So a large group of rows about one text, near it or not, doesn't make the
    pairs of rows that can't be linked."""
    labelled = _labelled(firsts, links)
    each = _table_rows(labelled, tables, bits, [F.col("size")]).drop("key")
    cells = each.groupBy("t", "part").agg(F.count("*").alias("k"), F.max(F.struct("size", "label", "doc_id"))["doc_id"].alias("largest"), F.min("label").alias("x"), F.max("label").alias("y"))
    cells = materialise(cells.where((F.col("k") > FEW) & (F.col("x") < F.col("y"))).select("t", "part", "largest"), "near-large")
    large = if_small(cells)
    ids = materialise(each.join(large, ["t", "part"], "left_semi").select("doc_id").distinct(), "near-large-ids")
    sets = shingle_sets(rows, ids, shingle_words)
    split = split_sets(sets, similarity)
    discard(sets)
    reach = if_small(split.select("doc_id", "reach"))

    held = each.join(large, ["t", "part"], "left_semi").join(reach, "doc_id").where(F.col("reach") >= similarity * F.col("n") - 1e-9)
    own = ["doc_id", "label", "n", "fp_1", "fp_2", "near"]
    hubs = held.groupBy("t", "part").agg(F.max_by(F.struct(*own), F.struct(F.col("reach") / F.col("n"), "size", "doc_id")).alias("o"))
    close, distance = _close("", "o.", similarity, radius)
    met = held.join(hubs, ["t", "part"]).where("label <> o.label").where(close)
    met = met.select(F.least("doc_id", "o.doc_id").alias("a"), F.greatest("doc_id", "o.doc_id").alias("b"), distance.alias("distance")).distinct()
    stars = materialise(_closest(met), "near-stars")
    links = links.unionByName(similar_pairs(rows, stars, shingle_words, similarity))

    labelled = _labelled(firsts, links)
    each = _table_rows(labelled, tables, bits, [F.col("size")]).drop("key")
    homes = materialise(cells.join(labelled.select(F.col("doc_id").alias("largest"), F.col("label").alias("home")), "largest").drop("largest"), "near-homes")
    held = each.join(if_small(homes), ["t", "part"]).join(reach, "doc_id")
    some = labelled.join(if_small(ids), "doc_id", "left_semi").select("doc_id", "label", "n", "fp_1", "fp_2", F.transform(F.slice("keys", 1, tables), lambda k: F.shiftrightunsigned(k, KEY - bits)).alias("parts"))
    few = materialise(few_pairs(each.join(large, ["t", "part"], "left_anti").join(reach, "doc_id", "left"), similarity, radius).distinct(), "near-few")
    common = materialise(common_pairs(held, similarity, radius).distinct(), "near-common-pairs")
    rare = materialise(rare_pairs(some, split, similarity, radius), "near-rare-pairs")  # one after the other: the driver holds what one of them broadcasts
    found = materialise(few.unionByName(common).unionByName(rare).distinct(), "near-cells")
    links = links.unionByName(similar_pairs(rows, found, shingle_words, similarity))
    for table in (cells, ids, split, stars, homes, few, common, rare, found):
        discard(table)
    return links


def few_pairs(each: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): all pairs of different labels and one cell that are close. Rows of a cell's largest label are met by the
    others alone. Where both rows' shingles have been counted (see common_pairs), they must reach each other."""
    few = each.withColumn("home", F.max(F.struct("size", "label")).over(Window.partitionBy("t", "part"))["label"])
    few = few.select("t", "part", "doc_id", "label", "home", "n", "fp_1", "fp_2", "near", "reach")
    a, b = few.where("label <> home").alias("a"), few.alias("b")
    close, _ = _close("a.", "b.", similarity, radius)
    once = (F.col("b.label") == F.col("b.home")) | (F.col("a.doc_id") < F.col("b.doc_id"))
    reached = F.expr("a.reach is null or b.reach is null or (b.n <= a.reach and a.n <= b.reach)")
    met = a.join(b.hint("merge"), (F.col("a.t") == F.col("b.t")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.label") != F.col("b.label")) & once & reached & close)
    return met.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))


def split_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, reach, rare) of sets (doc_id, grams): how many shingles a partner has at most that shares common ones
    alone, those that more than RARE of the sets have, and a prefix of the others.

    Sets of m and n shingles that share common ones alone are linked only if either has similarity / (1 + similarity) *
    (m + n) of them; that gives the reach. A partner shares similarity times the larger set at least, so beyond `common` a set of n shingles shares similarity *
    n - common rare ones with it, if any: all but so many less one are its prefix, in the order of their hashes. A linked
    pair that shares none of its prefixes shares common shingles alone."""
    each = sets.select("doc_id", F.explode("grams").alias("gram"))
    hot = materialise(each.groupBy("gram").agg(F.count("*").alias("sets")).where(F.col("sets") > RARE).select("gram"), "near-common")
    own = each.join(hot, "gram").groupBy("doc_id").agg(F.collect_list("gram").alias("hot"))
    own = sets.join(own, "doc_id", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<long>")))
    shared = F.greatest(F.lit(1), (F.ceil(similarity * F.size("grams") - 1e-9) - F.size("hot")).cast("int"))
    rare = F.array_except("grams", "hot")
    reach = F.floor(F.size("hot") * ((1 + similarity) / similarity) + 1e-6) - F.size("grams")
    split = own.select("doc_id", reach.alias("reach"), F.slice(rare, 1, F.greatest(F.lit(0), F.size(rare) - shared + 1)).alias("rare"))
    split = materialise(split, "near-split")
    discard(hot)
    return split


def rare_pairs(some: DataFrame, split: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): pairs of different labels that share a rare shingle of their prefixes, which RARE rows have at most, and a
    cell (one of `parts`), and are close."""
    own = split.join(some.select("doc_id", "label", "n"), "doc_id").select(F.struct("doc_id", "label", "n").alias("at"), F.explode("rare").alias("gram"))
    lists = own.groupBy("gram").agg(F.array_sort(F.collect_list("at")).alias("ats")).where(F.size("ats") > 1)
    fits = lambda x: lambda y: (x["label"] != y["label"]) & (F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]) - 1e-9)
    after = lambda x, i: F.filter(F.slice("ats", i + 2, F.size("ats")), fits(x))
    pairs = F.flatten(F.transform("ats", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b")))))
    met = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    wide = lambda j: [F.bit_count(F.col(f"fp_{i}").bitwiseXOR(F.lit(_signed(_pivot(2 * j + i))))).cast("long") for i in (1, 2)]
    side = some.withColumn("near", _packed([sum(wide(j)) for j in range(WIDE_PIVOTS)], 8))
    a, b = side.alias("a"), side.alias("b")
    close, _ = _close("a.", "b.", similarity, radius)
    met = met.withColumnsRenamed({"a": "one", "b": "two"}).join(a, F.col("one") == F.col("a.doc_id")).join(b, (F.col("two") == F.col("b.doc_id")) & close)
    same = F.exists(F.zip_with("a.parts", "b.parts", lambda x, y: x == y), lambda x: x)
    return met.where(same).select(F.col("one").alias("a"), F.col("two").alias("b"))


def common_pairs(held: DataFrame, similarity: float, radius: int) -> DataFrame:
    """(a, b): pairs of different labels and one cell that are close and reach each other (see split_sets).

    The smaller of two rows (b) must reach one of its own size. Rows meet by cell and band of the smaller one's size: a
    row whose many shingles of its own leave it a reach below the group's sizes doesn't meet the group, and rows of the
    cell's largest label don't meet each other."""
    each = held.where(F.col("reach") >= similarity * F.col("n") - 1e-9).withColumn("at_home", F.col("label") == F.col("home"))
    each = each.select("t", "part", "doc_id", "label", "at_home", "n", "fp_1", "fp_2", "near", "reach")
    band = lambda n: F.floor(BANDS * F.log(n.cast("double")))
    bands = F.sequence(band(F.greatest(F.lit(1), F.floor(similarity * F.col("n") - 1e-6))), band(F.least("reach", "n")))
    a = each.withColumn("band", F.explode(bands)).withColumn("home", F.explode(F.when(F.col("at_home"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).alias("a")
    b = each.where("reach >= n").withColumn("band", band(F.col("n"))).withColumn("home", F.col("at_home")).alias("b")
    close, _ = _close("a.", "b.", similarity, radius)
    sized = (F.col("b.n") <= F.col("a.reach")) & (F.col("a.n") <= F.col("b.reach")) & (F.struct("b.n", "b.doc_id") < F.struct("a.n", "a.doc_id"))
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "part", "band", "home")))
    met = a.join(b.hint("merge"), same & (F.col("a.label") != F.col("b.label")) & sized & close)
    return met.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))


def shingle_sets(rows: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, grams): the sorted hashes of the shingles of rows (doc_id, text) whose doc_id is in ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle_words).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["doc_id", "grams"])

        return step

    return materialise(map_batches(rows.join(if_small(ids), "doc_id", "left_semi"), make, f"doc_id {kind}, grams array<long>"), "near-sets")


def similar_pairs(rows: DataFrame, pairs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows (doc_id, text) whose sets of shingles have at least that Jaccard similarity."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
    sets = shingle_sets(rows, ids, shingle_words)
    one = lambda c: sets.select(F.col("doc_id").alias(c), F.col("grams").alias(f"{c}_grams"))
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    either = F.size("a_grams") + F.size("b_grams") - both
    found = materialise(pairs.join(one("a"), "a").join(one("b"), "b").where(both >= similarity * either - 1e-9).select("a", "b"), "near-pairs")
    discard(sets)
    return found


def _labelled(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of sketches() with the component that links so far give them, and its number of rows."""
    labels = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    labelled = firsts.join(labels.join(sizes, "label"), "doc_id", "left")
    return labelled.withColumns({"label": F.coalesce("label", "doc_id"), "size": F.coalesce("size", F.lit(1))})


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, recall: float = 0.97) -> DataFrame:
    """(doc_id, component_id), a row an input row: the smallest id that links of at least that similarity reach.

    Similarity is the Jaccard index of the sets of shingles (lower-case words, white space apart). Sets are sketched by
    wide SimHash fingerprints; wide_candidates finds close ones; every link is verified on the whole sets, so nothing
    below the similarity is linked. Of links at exactly that similarity the share `recall` is expected to be found
    directly (more of closer ones, and more through other links): the number of tables follows from it and from the
    number of rows. A quarter of the tables gives each row's FIRST closest candidates, which are verified and make
    components; then all tables give the candidates side by side of different components (of those that share a key's first
    bits the closest, as the rest comes last); last, the pairs of different components that share the first bits of a key
    in any table, however many rows do, unless their shingles rule a link out (cell_links). So no cell is capped, and
    a large group of near copies costs links in proportion to its rows.

    Equal sets are one class, as are null and wordless texts. Ids must be unique and not null. Texts are read whole,
    however long. An empty table gives no rows; other columns are not read."""
    rows = text_rows(docs, id_col, text_col)
    count = rows.count()
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi  # expected share of differing bits at the similarity
    radius = round(WIDE * differ + 3 * math.sqrt(WIDE * differ * (1 - differ)))
    depth = max(8.0, math.log2(max(1, count / BESIDE)))  # bits that rows side by side share by chance
    tables = math.ceil(-math.log(1 - recall) / (1 - differ) ** depth)
    each = materialise(sketches(rows, shingle_words, tables), "sketches")
    ids = each.select("doc_id", "digest")
    classes = materialise(ids.groupBy("digest").agg(F.min("doc_id").alias("rep")), "sketch-classes")
    firsts = materialise(each.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").drop("digest"), "sketch-firsts")
    bits = math.ceil(depth)
    closest = materialise(_closest(wide_candidates(firsts.withColumn("label", F.col("doc_id")), count, similarity, radius, math.ceil(tables / 4), bits)), "near-closest")
    links = similar_pairs(rows, closest, shingle_words, similarity)
    labelled = _labelled(firsts, links)
    beside = materialise(wide_candidates(labelled, count, similarity, radius, tables, bits), "near-beside")
    left = materialise(_closest(beside.where("not apart")).unionByName(beside.where("apart").select("a", "b")).distinct(), "near-left")
    links = links.unionByName(similar_pairs(rows, left, shingle_words, similarity))
    links = cell_links(rows, firsts, links, shingle_words, similarity, radius, tables, bits)
    named = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = materialise(ids.join(named, "digest").select("doc_id", "component_id"), "near-components")
    for table in (each, classes, firsts, closest, beside, left):
        discard(table)
    return found


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")

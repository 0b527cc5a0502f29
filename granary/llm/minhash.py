"""MinHash near-duplicates: an inverted join over signature coordinates, confirmed on whole sets."""

from __future__ import annotations

from functools import reduce
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, documents, gram_hashes, if_small, map_batches, materialise, multipliers, word_hashes
from granary.llm.components import components

#: Coordinates of a signature, and the bits of each that a posting carries.
COORDINATES, PLANES = 64, 8
#: Share of links at exactly the similarity that may fall below the match threshold.
MISSED = 1e-6
PLANE = [f"plane_{i}" for i in range(PLANES)]
#: Hubs that each set is checked against before other candidates are looked for.
FIRST = 3
#: Most sets that a rare shingle is in.
RARE = 16


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted. A-Z are lower-cased; a text of fewer words is one shingle, a text
    without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    short = len(words) if len(words) < shingle_words else 0
    return np.unique(gram_hashes(word_hashes(words), short or shingle_words, short))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row a set, which must not be empty: for each coordinate the upper half of the least of the hashes, multiplied
    and moved by the coordinate's own numbers."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    if sets:
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        for j, (a, b) in enumerate(zip(multipliers(COORDINATES, 11), multipliers(COORDINATES, 12))):
            out[:, j] = np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32)
    return out


def sign_planes(found: np.ndarray) -> np.ndarray:
    """A row a signature: PLANES numbers of a bit a coordinate, the lowest bits of its values."""
    bits = found[:, None, :] >> np.arange(PLANES, dtype=np.uint32)[None, :, None] & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=2).view(np.int64)[:, :, 0] if len(found) else np.zeros((0, PLANES), np.int64)


def match_threshold(similarity: float, missed: float = MISSED, coordinates: int = COORDINATES) -> int:
    """The most coordinates that may be asked to match, so that of pairs of exactly that similarity at most a share
    `missed` has fewer: matches are binomial."""
    below, least = 0.0, 0
    while least < coordinates and (below := below + comb(coordinates, least) * similarity**least * (1 - similarity) ** (coordinates - least)) <= missed:
        least += 1
    return least


def _sketches(rows: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text_key, n, digest, signature, plane_0 ...) of rows (doc_id, text_key, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(t, shingle_words) for t in batch.column(2).to_pylist()]
            some = [s for s in sets if len(s)]
            found, planes = signatures(some), np.zeros((len(sets), PLANES), np.int64)
            planes[[i for i, s in enumerate(sets) if len(s)]] = sign_planes(found)
            ends = np.cumsum([0, *(COORDINATES * bool(len(s)) for s in sets)]).astype(np.int32)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int32).ravel())), *map(pa.array, planes.T)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "text_key", "n", "digest", "signature", *PLANE])

        return step

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, text_key long, n long, digest binary, signature array<int>, " + ", ".join(f"{p} long" for p in PLANE))


def _may_match(a: str, b: str) -> Column:
    """At least as many coordinates as match: those whose carried bits are all equal."""
    apart = reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"{a}.plane_{i}").bitwiseXOR(F.col(f"{b}.plane_{i}")) for i in range(PLANES)))
    return COORDINATES - F.bit_count(apart)


def _sized(a: str, b: str, similarity: float) -> Column:
    return F.least(f"{a}.n", f"{b}.n") >= similarity * F.greatest(f"{a}.n", f"{b}.n") - 1e-9


CARRIED = ["c", "n", *PLANE]


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, apart, before, c, n, plane_0 ...): each set under the coordinate-value pairs of its prefix, with those that
    stand before it there. apart is the smaller, the more its pairs are shared.

    All pairs are put in one order, rare ones first. Two sets that share at least `matches` of their pairs share one
    among the first COORDINATES - matches + 1 of either's. Pairs of a single set come first in the order and are never
    posted, and a set with fewer than `matches` other ones has no partner. The frequent pairs at the end, whose lists
    are long, are skipped: they are only compared for sets that meet in a prefix."""
    token = lambda v, j: j * F.lit(1 << 32) + v
    tokens = classes.select("c", F.explode(F.transform("signature", token)).alias("token"))
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "minhash-tokens")
    own = tokens.join(if_small(shared), "token").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("own"))
    apart = F.aggregate("own", F.lit(0.0), lambda s, x: s - F.log(x["sets"].cast("double"))).alias("apart")
    own = own.where(F.size("own") >= matches).select("c", apart, F.slice("own", 1, F.size("own") - matches + 1)["token"].alias("own"))
    each = own.join(classes.select(*CARRIED), "c").select("own", "apart", F.posexplode("own").alias("i", "token"), *CARRIED)
    return materialise(each.select("token", "apart", F.slice("own", 1, F.col("i")).alias("before"), *CARRIED), "minhash-postings")


def _matching(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b ...) whose signatures agree in at least `matches` coordinates, with that number as met."""
    side = lambda c: classes.select(F.col("c").alias(c), F.col("signature").alias(f"{c}_signature"))
    same = F.aggregate(F.zip_with("a_signature", "b_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, same.alias("met")).where(F.col("met") >= matches)


def _whole_sets(members: DataFrame, rows: DataFrame, classes: DataFrame, shingle_words: int) -> DataFrame:
    """(c, grams): the sorted hashes of the shingles of the classes in members (c)."""
    wanted = if_small(materialise(classes.join(members, "c", "left_semi").select("c", "at.no_id", "at.doc_id", "at.text_key"), "minhash-wanted"))
    met = rows.withColumn("no_id", F.col("doc_id").isNull()).join(wanted.withColumnRenamed("doc_id", "rep"), ["text_key", "no_id"]).where("doc_id <=> rep").select("c", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(t, shingle_words).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))], ["c", "grams"])

        return step

    return materialise(map_batches(met, make, "c long, grams array<long>").groupBy("c").agg(F.first("grams").alias("grams")), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have at least that similarity."""
    side = lambda c: sets.select(F.col("c").alias(c), F.col("grams").alias(f"{c}_grams"))
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    either = F.size("a_grams") + F.size("b_grams") - both
    return materialise(pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").where(both >= similarity * either - 1e-9).select("a", "b"), "minhash-links")


def _split_sets(sets: DataFrame, similarity: float) -> DataFrame:
    """(c, common, rare): the number of a set's shingles that more than RARE sets have, and a prefix of its others.

    A link's sets share similarity times the larger one at least, so beyond `common` a set of n shingles shares
    similarity * n - common rare ones with each partner: all but so many less one are its prefix, in the order of their
    hashes. Two sets that share none of their prefixes share no more than the smaller `common`."""
    each = sets.select("c", F.explode("grams").alias("gram"))
    hot = materialise(each.groupBy("gram").agg(F.count("*").alias("sets")).where(F.col("sets") > RARE).select("gram"), "minhash-common")
    own = each.join(if_small(hot), "gram").groupBy("c").agg(F.collect_list("gram").alias("hot"))
    rows = sets.join(own, "c", "left").select("c", F.size("grams").alias("n"), F.coalesce(F.size("hot"), F.lit(0)).alias("common"), F.when(F.col("hot").isNull(), F.col("grams")).otherwise(F.array_except("grams", "hot")).alias("rare"))
    shared = F.greatest(F.lit(1), (F.ceil(similarity * F.col("n") - 1e-9) - F.col("common")).cast("int"))
    return materialise(rows.select("c", "common", F.slice("rare", 1, F.greatest(F.lit(0), F.size("rare") - shared + 1)).alias("rare")), "minhash-split")


def _rare_pairs(split: DataFrame) -> DataFrame:
    """(a, b), a < b: sets that share a rare shingle of their prefixes; each is in RARE sets at most."""
    lists = split.select("c", F.explode("rare").alias("gram")).groupBy("gram").agg(F.array_sort(F.collect_list("c")).alias("cs")).where(F.size("cs") > 1)
    pairs = F.flatten(F.transform("cs", lambda x, i: F.transform(F.slice("cs", i + 2, F.size("cs")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def set_links(classes: DataFrame, rows: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Links (a, b) between classes of equal sets that join exactly the classes which links of at least that similarity
    join, whatever their number: pairs that other links have joined already are left out.

    First each class meets the hubs of its postings (the class of each whose pairs are shared most, as those of a text
    that others are copies of, and one drawn by hash) and is checked against the FIRST most similar ones; that joins most of a large group of near copies by a few links a member. Then
    classes of different components meet. A pair either shares a rare shingle, or no more than the smaller number of
    common ones: the former come from the rare shingles' own short lists, the latter from the postings that still hold
    several components, where too few common shingles rule a pair out. Of any two components the most similar pair is
    checked, then every pair that is still between two. All pairs must match in match_threshold() coordinates before
    whole sets are compared."""
    matches = match_threshold(similarity)
    postings = prefix_postings(classes, matches)
    sets = _whole_sets(postings.select("c").distinct(), rows, classes, shingle_words)
    drawn = F.min(F.struct(F.xxhash64("token", "c").alias("draw"), *CARRIED)).alias("drawn")
    hubs = postings.groupBy("token").agg(F.min(F.struct("apart", *CARRIED)).alias("least"), drawn, F.count("*").alias("sets")).where("sets > 1")
    hubs = hubs.select("token", F.explode(F.array(F.struct(*(F.col(f"least.{x}").alias(x) for x in CARRIED)), F.struct(*(F.col(f"drawn.{x}").alias(x) for x in CARRIED)))).alias("hub"))
    met = postings.alias("own").join(hubs, "token").where("hub.c <> own.c").where((_may_match("own", "hub") >= matches) & _sized("own", "hub", similarity))
    stars = met.select(F.col("own.c").alias("own"), F.least("hub.c", "own.c").alias("a"), F.greatest("hub.c", "own.c").alias("b")).distinct()
    stars = _matching(stars, classes, matches)
    best = stars.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("met"), "a", "b"))).where(F.col("place") <= FIRST)
    checked = materialise(best.select("a", "b").distinct(), "minhash-checked")
    links = _confirmed(checked, sets, similarity)
    labels = materialise(components(links).select(F.col("node").alias("c"), F.col("component").alias("label")), "minhash-labels")

    split = _split_sets(sets, similarity)
    own = split.select("c", "common").join(labels, "c", "left").select("c", "common", F.coalesce("label", "c").alias("label"))
    named = materialise(postings.join(own, "c"), "minhash-named")
    several = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    open_rows = materialise(named.join(several, "token", "left_semi"), "minhash-open")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    enough = F.least("a.common", "b.common") >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-9
    first_met = ~F.arrays_overlap("a.before", "b.before")  # a pair is made in one posting only
    near = (F.col("a.token") == F.col("b.token")) & (F.col("a.label") < F.col("b.label")) & enough & _sized("a", "b", similarity) & (_may_match("a", "b") >= matches) & first_met
    met = a.join(b, near).select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b"))
    met = met.unionByName(_rare_pairs(split)).distinct().join(checked, ["a", "b"], "left_anti")
    pairs = materialise(_matching(_apart(met, labels), classes, matches), "minhash-pairs")
    best = pairs.groupBy("a_label", "b_label").agg(F.max_by(F.struct("a", "b"), F.struct("met", "a", "b")).alias("p")).select("p.a", "p.b")
    best = materialise(best, "minhash-best")
    links = links.unionByName(_confirmed(best, sets, similarity))
    labels = materialise(components(links).select(F.col("node").alias("c"), F.col("component").alias("label")), "minhash-labels")
    rest = materialise(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), labels), "minhash-rest")
    found = links.unionByName(_confirmed(rest, sets, similarity))
    for table in (postings, sets, named, open_rows, split):
        discard(table)
    return found


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, a_label, b_label): the pairs of different components; a class without a label is its own. Labels are in
    order, whichever is whose."""
    side = lambda c: labels.select(F.col("c").alias(c), F.col("label").alias(f"{c}_own"))
    x, y = F.coalesce("a_own", "a"), F.coalesce("b_own", "b")
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(x != y).select("a", "b", F.least(x, y).alias("a_label"), F.greatest(x, y).alias("b_label"))


def minhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id is
    the component_id). Documents link at a Jaccard similarity of at least `similarity` of their sets of shingles.

    Equal sets are one class and cost no pairs. Classes meet under coordinate-value pairs of their signatures, see
    prefix_postings and set_links; a link is missed with a chance of at most MISSED, and every link is confirmed on the
    whole sets of 64-bit hashes of shingles.

    Null and wordless texts have empty sets and link with nothing. Texts are read whole. A row with a null doc_id
    carries links like any other and gets its component's smallest id, null where there is none; rows that repeat a
    doc_id give a row each. An empty table gives an empty result. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    each = materialise(_sketches(rows, shingle_words), "minhash-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("at")
    classes = each.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("signature").alias("signature"), *(F.first(p).alias(p) for p in PLANE))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "minhash-classes")
    labels = components(set_links(classes, rows, shingle_words, similarity)).select(F.col("node").alias("c"), F.col("component").alias("label"))
    named = classes.select("c", "digest", F.col("at.doc_id").alias("rep")).join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    named = materialise(named.drop("c"), "minhash-components")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("digest", "component_id", F.lit(True).alias("has"))
    key = F.when(F.col("n") > 0, F.col("digest"))  # empty sets meet nobody
    out = each.select("doc_id", "n", key.alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op11_minhash_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(documents(spark, sf_dir), shingle_words=3, similarity=0.85)


OP11_SQL = r"""
with recursive words as (select doc_id, string_split_regex(body, '[\x20\x09-\x0D]+') as w from (
  select doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as body from documents) where body <> ''),
shingles as (select distinct doc_id, md5(array_to_string(w[i:i + 2], ' ')) as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
met as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
way as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as other from way union select doc_id, b from reach join way on a = other),
least as (select doc_id, min(other) as other from reach group by doc_id)
select documents.doc_id, coalesce(n, 0) as n_shingles, least(documents.doc_id, coalesce(other, documents.doc_id)) as component_id,
  documents.doc_id <= coalesce(other, documents.doc_id) as kept
from documents left join sizes on sizes.doc_id = documents.doc_id left join least on least.doc_id = documents.doc_id
"""

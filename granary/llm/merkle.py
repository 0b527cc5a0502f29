"""Merkle manifests of a dataset: hash trees stored as blocks of nodes in van Emde Boas order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from granary.llm.common import documents, if_small, map_batches, materialise

#: Levels of links in a block: a block is an aligned subtree of at most 2 ** BLOCK_HEIGHT bottom nodes.
BLOCK_HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a path says of each level: no sibling, one on the left, one on the right.
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def veb_addresses(height: int, known: dict = {}) -> list[np.ndarray]:  # noqa: B006
    """For each depth of a complete binary tree of height links, the addresses of its nodes from left to right.

    The tree is cut at half of its levels: the upper part comes first, then the lower subtrees one after the other,
    each laid out by the same rule, so a path from bottom to top stays in few stretches whatever the cache's size."""
    if height not in known:
        if height == 0:
            known[height] = [np.zeros(1, np.int64)]
        else:
            upper = (height + 1) // 2  # levels of nodes in the upper part, of height + 1 in all
            top, low = veb_addresses(upper - 1), veb_addresses(height - upper)
            size = (1 << height - upper + 1) - 1
            starts = (1 << upper) - 1 + size * np.arange(1 << upper, dtype=np.int64)
            known[height] = [*top, *((starts[:, None] + depth[None, :]).ravel() for depth in low)]
    return known[height]


def block_height(count: int, siblings: int) -> int:
    """Links of a block with `count` bottom nodes among `siblings` of them in the group: those of a whole block where
    the group has several, else as many as its nodes need."""
    return BLOCK_HEIGHT if siblings > 1 << BLOCK_HEIGHT else max(0, count - 1).bit_length()


def build_block(leaves: list[bytes], height: int) -> bytes:
    """The nodes above and with the given bottom nodes (32 bytes each), at their addresses; absent ones are zeros."""
    out, at = bytearray(32 * ((2 << height) - 1)), veb_addresses(height)
    row = [x.hex() for x in leaves]
    for depth in range(height, -1, -1):
        for address, node in zip(at[depth], row):
            out[32 * address : 32 * address + 32] = bytes.fromhex(node)
        row = [hashlib.sha256("".join(row[i : i + 2]).encode()).hexdigest() for i in range(0, len(row), 2)]
    return bytes(out)


def sibling_path(nodes: bytes, height: int, count: int, at: int) -> bytes:
    """What stands beside the way from bottom node `at` to the block's top: 33 bytes a level, a side and a digest."""
    address, out = veb_addresses(height), []
    for depth in range(height, 0, -1):
        beside = at ^ 1
        if beside < -(-count >> height - depth):
            spot = 32 * address[depth][beside]
            out.append((LEFT if beside < at else RIGHT) + nodes[spot : spot + 32])
        else:
            out.append(ALONE + bytes(32))
        at >>= 1
    return b"".join(out)


def fold(leaf: str, path: bytes) -> str:
    """The root (hex) that a leaf and its path give."""
    for i in range(0, len(path), 33):
        side, beside = path[i : i + 1], path[i + 1 : i + 33].hex()
        leaf = hashlib.sha256((leaf if side == ALONE else beside + leaf if side == LEFT else leaf + beside).encode()).hexdigest()
    return leaf


def proof_digest(path: bytes) -> str:
    """H of a path's siblings (hex), from the leaf to the root."""
    return hashlib.sha256("".join(path[i + 1 : i + 33].hex() for i in range(0, len(path), 33) if path[i : i + 1] != ALONE).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """H of values, each as its byte count, a colon and itself, or `-` where it is null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, their place within the group, and siblings, the group's size. The rows are dealt by ranges of
    (group, order), so a group of any size lies in many tasks; only counts a range are added up."""
    each = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    each = materialise(each.withColumn("at", F.monotonically_increasing_id()), "ranked")  # range number and place in it
    each = each.withColumn("range", F.shiftright("at", 33))
    sizes = each.groupBy(group, "range").agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = materialise(sizes.select(group, "range", (before - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy(group)).alias("siblings")), "ranges")
    return each.join(if_small(sizes), [group, "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(g, block, count, siblings, members, nodes, root) of nodes (g, pos, siblings, digest, carried ...)."""
    own = F.array_sort(F.collect_list(F.struct("pos", "digest", *carried)))
    rows = nodes.groupBy("g", F.shiftright("pos", BLOCK_HEIGHT).alias("block")).agg(F.first("siblings").alias("siblings"), own.alias("members"))
    rows = rows.select("g", "block", F.size("members").alias("count"), "siblings", "members")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            stored, roots = [], []
            for count, siblings, members in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                height = block_height(count, siblings)
                nodes = build_block(members.values.field("digest").to_pylist(), height)
                stored.append(nodes)
                roots.append(nodes[:32])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary()), pa.array(roots, pa.binary())], [*batch.schema.names, "nodes", "root"])

        return step

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialise(map_batches(rows, make, f"{kinds}, nodes binary, root binary"), "merkle-blocks")


def build_trees(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The blocks of every group's tree, level by level: block roots are the bottom nodes of the next one.

    A level has a 2 ** BLOCK_HEIGHT-th of the rows of the one below, so there are two or three of them."""
    whole, levels = 1 << BLOCK_HEIGHT, [_blocks(nodes, carried)]
    while not levels[-1].where(F.col("siblings") > whole).isEmpty():
        over = F.ceil(F.col("siblings") / whole).cast("long")
        up = levels[-1].where(F.col("siblings") > whole).select("g", F.col("block").alias("pos"), over.alias("siblings"), F.col("root").alias("digest"))
        levels.append(_blocks(up, []))
    return levels


def tree_roots(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): each group's root."""
    parts = [level.where(F.col("siblings") <= 1 << BLOCK_HEIGHT).select("g", F.col("root").alias("digest")) for level in levels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _expand(rows: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """visit(row as a dict) gives tuples of the schema, for each row of a few blocks."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = visit(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found)))), schema=kinds)

    kinds = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(run, schema)


def descend(levels: list[DataFrame], tops: DataFrame, visit: Callable, schema: str) -> DataFrame:
    """Goes down the trees with a path for each block: tops has (g, subroot, above, root), the path from a group's root
    on. At the bottom visit(block row) makes the result's rows. Each step is an equi-join on (g, block), a row a block."""
    whole, inner = 1 << BLOCK_HEIGHT, None

    def children(row: dict):
        for at in range(row["count"]):
            own = sibling_path(row["nodes"], block_height(row["count"], row["siblings"]), row["count"], at)
            yield row["g"], (row["block"] << BLOCK_HEIGHT) + at, row["subroot"], own + row["above"], row["root"]

    for depth, level in reversed([*enumerate(levels)]):
        level = level.drop("root")
        rows = level.where(F.col("siblings") <= whole).join(tops, "g")
        if inner is not None:
            rows = rows.unionByName(level.where(F.col("siblings") > whole).join(inner, ["g", "block"]))
        if depth:
            rows = rows.select("g", "block", "count", "siblings", "nodes", "subroot", "above", "root")
            inner = materialise(_expand(rows, children, "g string, block long, subroot binary, above binary, root binary"), "merkle-paths")
    return _expand(rows, visit, schema)


def merkle_proofs(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves (doc_id, g, leaf, seen), one row
    each: g names its group, not null and in the groups' order; leaf is its digest in the manifest, and seen the digest
    that is checked against it. Digests are lower-case hex.

    Leaves stand by doc_id (null first), equal ones by digest. Each group's tree and the tree over the groups' roots are
    built bottom up from blocks of aligned subtrees, stored in van Emde Boas order; paths go down block by block. A
    block is at most 1,024 nodes, so no task holds more of a group, and texts are not shuffled. Rows that repeat are
    leaves of their own. An empty table gives an empty result."""
    rows = leaves.select("g", "doc_id", F.unhex("leaf").alias("digest"), F.when(F.col("seen") != F.col("leaf"), F.unhex("seen")).alias("seen"))
    levels = build_trees(ranked(materialise(rows, "leaves"), "g", ["doc_id", "digest", "seen"]), ["doc_id", "seen"])
    roots = tree_roots(levels).select(F.lit("").alias("all"), F.col("g").alias("name"), "digest")
    above = build_trees(ranked(roots, "all", ["name"]).select(F.col("all").alias("g"), "pos", "siblings", "digest", "name"), ["name"])
    top = tree_roots(above).select("g", F.col("digest").alias("subroot"), F.lit(b"").alias("above"), F.col("digest").alias("root"))

    def group_paths(row: dict):
        for at, member in enumerate(row["members"]):
            own = sibling_path(row["nodes"], block_height(row["count"], row["siblings"]), row["count"], at)
            yield member["name"], member["digest"], own + row["above"], row["root"]

    tops = materialise(descend(above, top, group_paths, "g string, subroot binary, above binary, root binary"), "merkle-tops")

    def proofs(row: dict):
        for at, member in enumerate(row["members"]):
            path = sibling_path(row["nodes"], block_height(row["count"], row["siblings"]), row["count"], at) + row["above"]
            folded, root = fold((member["seen"] or member["digest"]).hex(), path), row["root"].hex()
            yield member["doc_id"], member["digest"].hex(), row["subroot"].hex(), root, proof_digest(path), folded, folded == root

    kind = leaves.schema["doc_id"].dataType.simpleString()
    return descend(levels, tops, proofs, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_leaves(docs: DataFrame, seen: dict[str, Column] | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, g, leaf, seen) of the rows of docs: leaf is H of the fields as they are, seen of the fields with the
    columns of `seen` in place of their own. A null group comes before all others. Other columns are not read."""
    name = F.col(group).cast("string")
    return docs.select(
        F.col(fields[0]).alias("doc_id"),
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("g"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        leaf_digest([(seen or {}).get(f, F.col(f)) for f in fields]).alias("seen"),
    )


def op13_merkle_veb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose unsigned crc32 of the decimal doc_id is a multiple of 7 are checked with n_chars one too high."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle_proofs(manifest_leaves(documents(spark, sf_dir), {"n_chars": tampered}))


OP13_SQL = r"""
with recursive bits as (select b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as x from (select unnest(range(256)) as b)),
crc as (select list(x order by b) as t from bits),
ids as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1])), 4294967295) % 7 = 0 as bad
  from (select distinct doc_id from documents where doc_id is not null), crc),
part as (select d.doc_id, d.lang, coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id, '-') || coalesce(strlen(d.source) || ':' || d.source, '-') || coalesce(strlen(d.lang) || ':' || d.lang, '-') as a,
  d.n_chars, d.n_chars + case when bad then 1 else 0 end as n_seen, coalesce(strlen(d.text) || ':' || d.text, '-') as z from documents d left join ids using (doc_id)),
leaf as (select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as h, sha256(a || coalesce(strlen(n_seen::varchar) || ':' || n_seen, '-') || z) as seen from part),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, h, seen) - 1 as i, count(*) over (partition by lang) as n, dense_rank() over (order by lang nulls first) - 1 as g from leaf),
tree as (
  select g, 0 as level, i, n, h from placed
  union all
  select g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from tree where n > 1 group by g, level, i // 2, n),
sub as (select g, h from tree where n = 1),
over as (
  select 0 as level, g as i, (select count(*) from sub) as n, h from sub
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from over where n > 1 group by level, i // 2, n),
nodes as (select g, level, i, h from tree union all select -1, level, i, h from over),
steps as (
  select g, i, level as step, g as in_g, level, i >> level as at from (select distinct g, i, n from placed), (select unnest(range(64)) as level) where level < ceil(log2(n))
  union all
  select g, i, 1000 + level, -1, level, g >> level from (select distinct g, i from placed), (select unnest(range(64)) as level) where level < ceil(log2((select count(*) from sub)))),
beside as (select s.g, s.i, row_number() over (partition by s.g, s.i order by step) as k, nodes.i < s.at as lefthand, nodes.h from steps s left join nodes on nodes.g = s.in_g and nodes.level = s.level and nodes.i = xor(s.at, 1)),
proof as (select g, i, sha256(coalesce(string_agg(h, '' order by k), '')) as p from beside group by g, i),
folded as (
  select g, i, 0 as k, seen as h from placed
  union all
  select f.g, f.i, f.k + 1, sha256(case when b.h is null then f.h when lefthand then b.h || f.h else f.h || b.h end) from folded f join beside b on b.g = f.g and b.i = f.i and b.k = f.k + 1),
last as (select g, i, arg_max(h, k) as h from folded group by g, i)
select doc_id, placed.h as leaf, sub.h as subroot, (select h from over where n = 1) as root, coalesce(p, sha256('')) as proof_sha256, last.h as folded_root, last.h = (select h from over where n = 1) as verified
from placed join sub using (g) left join proof using (g, i) join last using (g, i)
"""

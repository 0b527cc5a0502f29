"""Rank fusion, context expansion and evidence packing over tables of ranked hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.tables import if_small, written
from granary.functions.text import collapse, filled, first_filled, strip

#: The published fusion constant; roles that count as leaves when a hit says nothing else.
RRF = 60
LEAVES = ["leaf", "unknown"]


def rrf_fuse(lists: list[DataFrame], k: int = 10, constant: int = RRF) -> DataFrame:
    """(query_id, chunk_id, score, rank): sum over the lists of 1 / (constant + rank); ties by chunk_id."""
    rows = reduce(DataFrame.unionByName, (x.select("query_id", "chunk_id", (1 / (F.lit(constant) + F.col("rank"))).alias("part")) for x in lists))
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= k)


def child_counts(chunks: DataFrame) -> DataFrame:
    """(parent_id, children): leaf chunks of each parent; a null or blank role counts as a leaf."""
    leaf = F.coalesce(filled(F.col("chunk_role")), F.lit("leaf")) == "leaf"
    return chunks.where(leaf & filled(F.col("parent_id")).isNotNull()).groupBy("parent_id").agg(F.count("*").alias("children"))


def select_leaf_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce(filled(F.col("chunk_role")), F.lit("leaf")) == "leaf")


def expand_parent_context(hits: DataFrame, chunks: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Each hit's parent in its place, once a query at its first hit; hits without one stay, with the reason."""
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"), F.col("doc_id").alias("parent_doc_id"))
    found = hits.join(parents, "parent_id", "left")
    status = F.when(filled(F.col("parent_id")).isNull(), "missing_parent_id").when(F.col("parent_doc_id").isNull(), "not_found").otherwise("found")
    found = found.withColumn("lookup_status", status)
    own = F.when(F.col("lookup_status") == "found", F.col("parent_id")).otherwise(F.concat(F.lit("#"), F.col("rank").cast("string")))
    found = found.withColumn("first", F.row_number().over(Window.partitionBy("query_id", own).orderBy("rank"))).where("first = 1")
    body = strip(F.coalesce("parent_text", F.lit("")))
    if most_chars:
        body = F.regexp_replace(F.substring(body, 1, most_chars), r"\s+$", "")
    is_parent = F.col("lookup_status") == "found"
    return found.select(
        "query_id",
        "rank",
        F.when(is_parent, F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(is_parent, body).otherwise(F.col("text")).alias("text"),
        "score",
        F.when(is_parent, F.col("chunk_id")).alias("child_chunk_id"),
        F.when(is_parent, F.substring(F.coalesce("text", F.lit("")), 1, 200)).alias("child_preview"),
        F.when(is_parent, "parent_child").otherwise("child").alias("retrieval_mode"),
        "lookup_status",
    )


def auto_merge(hits: DataFrame, chunks: DataFrame, threshold: float = 0.5, most_chars: int = 4000) -> DataFrame:
    """Where a query's distinct leaf hits are at least threshold of a parent's leaves, one parent row replaces all of
    that parent's hits, at the first one's rank, with the largest leaf score. A parent without text leaves its distinct
    leaf hits as they are. Ranks are dealt anew.

    All of this is decided on narrow rows; parents' texts are read for the chosen ones, hits' texts joined at the end.
    (query_id, rank) must be unique in hits."""
    key = ["query_id", "parent_id"]
    leaf = F.coalesce(filled(F.col("chunk_role")), F.lit("unknown")).isin(LEAVES) & filled(F.col("parent_id")).isNotNull()
    narrow = written(hits.select("query_id", "rank", "chunk_id", "parent_id", "score", leaf.alias("leaf")), "merge-hits")
    once = narrow.where("leaf").groupBy(*key, "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    groups = once.groupBy(*key).agg(F.count("*").alias("found"), F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("members"))
    groups = groups.join(child_counts(chunks), "parent_id").where(F.col("found") / F.col("children") >= threshold)
    groups = written(groups.join(narrow.groupBy(*key).agg(F.min("rank").alias("at")), key), "merge-groups")
    wanted = if_small(written(groups.select("parent_id").distinct(), "merge-parents"))
    body = strip(F.coalesce("text", F.lit("")))
    parents = chunks.join(wanted.withColumnRenamed("parent_id", "chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("parent_id"), F.regexp_replace(F.substring(body, 1, most_chars), r"\s+$", "").alias("parent_text"))
    chosen = groups.join(parents.where("parent_text <> ''"), "parent_id", "left")
    none = lambda kind: F.lit(None).cast(kind)
    merged = chosen.where("parent_text is not null").select("query_id", F.col("at").alias("rank"), F.lit(0).alias("sub"), F.col("parent_id").alias("chunk_id"), none("string").alias("parent_id"), F.col("best").alias("score"), F.lit(True).alias("auto_merged"), F.round(F.col("found") / F.col("children"), 4).alias("merge_ratio"), F.transform("members", lambda m: m["chunk_id"]).alias("child_chunk_ids"), none("int").alias("hit_rank"), "parent_text")
    plain = lambda df, rank, sub: df.select("query_id", rank.alias("rank"), sub.alias("sub"), "chunk_id", "parent_id", "score", F.lit(False).alias("auto_merged"), none("double").alias("merge_ratio"), none("array<string>").alias("child_chunk_ids"), F.col("rank").cast("int").alias("hit_rank"), none("string").alias("parent_text"))
    rest = plain(narrow.join(groups, key, "left_anti"), F.col("rank"), F.lit(0))
    bare = plain(once.join(chosen.where("parent_text is null").select(*key, "at"), key), F.col("at"), F.col("rank").cast("int"))
    out = merged.unionByName(rest).unionByName(bare)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "sub", "chunk_id")))
    texts = hits.select("query_id", F.col("rank").cast("int").alias("hit_rank"), "text")
    return out.join(texts, ["query_id", "hit_rank"], "left").withColumn("text", F.coalesce("parent_text", "text")).select("query_id", "rank", "chunk_id", "parent_id", "text", "score", "auto_merged", "merge_ratio", "child_chunk_ids")


def table_id(text: Column, own: Column) -> Column:
    """A table's id from its column or the text's marker; '' without one."""
    marker = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\[TABLE_ID:\s*([^\]\n]+)\]", 1)
    return first_filled(own, marker)


def table_pages(text: Column, *own: Column) -> Column:
    marker = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\[TABLE_PAGE_RANGE:\s*([^\]\n]+)\]", 1)
    return first_filled(*own, marker)


def expand_table_context(hits: DataFrame, chunks: DataFrame, most_chars: int | None = None) -> DataFrame:
    """A hit that names a table becomes all non-root chunks of that document and table: distinct texts by chunk_index,
    a blank line between, once a query and table at the first hit. A table without chunks leaves its first hit."""
    known = chunks.withColumn("t", table_id(F.col("text"), F.col("table_id"))).where((F.col("t") != "") & (F.coalesce("chunk_role", F.lit("")) != "root"))
    known = known.select("doc_id", "t", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "chunk_id", "page_range", strip(F.coalesce("text", F.lit(""))).alias("body"))
    asked = hits.withColumn("t", table_id(F.col("text"), F.col("table_id")))
    named = asked.where("t <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "t").orderBy("rank"))).where("nth = 1").drop("nth")
    known = known.join(named.select("doc_id", "t").distinct(), ["doc_id", "t"], "left_semi")
    counts = known.groupBy("doc_id", "t").agg(F.count("*").alias("node_count"), F.min_by("page_range", F.struct("chunk_index", "chunk_id")).alias("first_range"))
    texts = known.where("body <> ''").groupBy("doc_id", "t", "body").agg(F.min(F.struct("chunk_index", "chunk_id")).alias("at"))
    texts = texts.groupBy("doc_id", "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n\n").alias("table_text"))
    if most_chars:
        texts = texts.withColumn("table_text", F.regexp_replace(F.substring("table_text", 1, most_chars), r"\s+$", ""))
    found = named.join(counts.join(texts, ["doc_id", "t"]), ["doc_id", "t"], "left")
    is_table = F.col("table_text").isNotNull()
    expanded = found.select("query_id", "rank", F.when(is_table, F.concat("t", F.lit("::context"))).otherwise(F.col("chunk_id")).alias("chunk_id"), F.when(is_table, F.col("table_text")).otherwise(F.col("text")).alias("text"), "score", F.when(is_table, F.col("chunk_id")).alias("child_chunk_id"), F.when(is_table, table_pages(F.col("table_text"), F.col("first_range"))).alias("table_page_range"), F.when(is_table, F.col("node_count")).alias("node_count"), F.when(is_table, "table_context").otherwise("child").alias("retrieval_mode"))
    nothing = lambda kind: F.lit(None).cast(kind)
    plain = asked.where("t = ''").select("query_id", "rank", "chunk_id", "text", "score", nothing("string").alias("child_chunk_id"), nothing("string").alias("table_page_range"), nothing("long").alias("node_count"), F.lit("child").alias("retrieval_mode"))
    return expanded.unionByName(plain)


def rerank_topn(hits: DataFrame, rerank_col: str = "rerank_score", top_n: int = 3, min_candidates: int = 6, enabled: bool = True) -> DataFrame:
    """Queries with at least min_candidates hits are ordered by the given score and cut to top_n; others stay as are."""
    counted = hits.withColumn("candidates", F.count("*").over(Window.partitionBy("query_id")))
    on = (F.col("candidates") >= min_candidates) & F.lit(enabled)
    order = Window.partitionBy("query_id").orderBy(F.when(on, F.col(rerank_col)).desc_nulls_last(), "rank", "chunk_id")
    return counted.withColumn("reranked", on).withColumn("rank", F.row_number().over(order)).where(~F.col("reranked") | (F.col("rank") <= top_n)).drop("candidates")


def pack_context(hits: DataFrame, most_chars: int = 4000) -> DataFrame:
    """(query_id, snippet_no, chunk_id, text): best scores first, equal texts (up to white space) once, until the
    budget of characters is used up; the last is cut."""
    rows = hits.select("query_id", "chunk_id", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''").withColumn("norm", collapse(F.col("text")))
    order = [F.desc("score"), F.asc("rank"), F.asc("chunk_id")]
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "norm").orderBy(*order))).where("nth = 1")
    by_query = Window.partitionBy("query_id").orderBy(*order)
    used = F.coalesce(F.sum(F.length("text")).over(by_query.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("used", used).withColumn("snippet_no", F.row_number().over(by_query)).where(F.col("used") < most_chars)
    return rows.select("query_id", "snippet_no", "chunk_id", F.substr("text", F.lit(1), (F.lit(most_chars) - F.col("used")).cast("int")).alias("text"))


def pack_evidence(hits: DataFrame, most_chars: int = 9000) -> DataFrame:
    """(query_id, rank, block): '[rank] label' and text in hit order, within the budget; blank texts keep their number."""
    rows = hits.select("query_id", "rank", first_filled(base_of(F.col("source_path")), F.col("doc_id"), F.lit("unknown_source")).alias("label"), strip(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    before = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("used") < most_chars)
    text = F.substr("text", F.lit(1), (F.lit(most_chars) - F.col("used")).cast("int"))
    return rows.select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("label"), F.lit("\n"), text).alias("block"))


def base_of(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def citations(hits: DataFrame, most: int = 5) -> DataFrame:
    """The hits of best score numbered from 1, naming child chunks and parent paths where there are any."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "rank", "chunk_id"))
    return hits.withColumn("source_no", place).where(F.col("source_no") <= most).select("query_id", "source_no", "doc_id", base_of(F.col("source_path")).alias("file_name"), "source_path", "chunk_id", "parent_id", "score")


def retrieval_quality(queries: DataFrame, hits: DataFrame, min_top1: float = 0.3, min_text: int = 100, most_sources: int = 5) -> DataFrame:
    """One row a query: top1 is the first hit's score, not the largest; verdict and reason in the order empty, low
    score, short text, good; bad queries are to be retried with 10."""
    text = F.length(strip(F.coalesce("text", F.lit(""))))
    got = hits.groupBy("query_id").agg(F.coalesce(F.min_by("score", "rank"), F.lit(0.0)).alias("top1_score"), F.count("*").alias("node_count"), F.sum(text).alias("total_text_length"), F.countDistinct(F.nullif("source_path", F.lit(""))).alias("source_count"), F.bool_or("auto_merged").alias("auto_merged"))
    rows = queries.select("query_id").join(got, "query_id", "left")
    reason = F.when(F.col("node_count").isNull(), "empty").when(F.col("top1_score") < min_top1, "low_top1").when(F.col("total_text_length") < min_text, "short_text").when(F.col("source_count") > most_sources, "good_scattered").otherwise("good")
    rows = rows.withColumn("reason", reason).withColumn("quality", F.when(F.col("reason").startswith("good"), "good").otherwise("bad"))
    rows = rows.withColumn("should_retry", F.col("quality") == "bad").withColumn("suggested_top_k", F.when(F.col("quality") == "bad", 10).otherwise(5))
    return rows.na.fill({"node_count": 0, "total_text_length": 0, "source_count": 0, "auto_merged": False})


def multi_query_union(hits: DataFrame) -> DataFrame:
    """Hits of a question's sub-queries in order; of equal keys the first stays. Ranks are dealt anew."""
    key = first_filled(F.col("chunk_id"), F.col("doc_id"), F.col("source_path"))
    once = hits.withColumn("nth", F.row_number().over(Window.partitionBy("question_id", key).orderBy("sub_index", "rank"))).where("nth = 1").drop("nth")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("sub_index", "rank", "chunk_id")))

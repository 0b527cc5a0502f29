"""Statistics of chunks, ingestion runs, traces and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import strip

#: Fixed value: the percentiles that are reported.
PERCENTILES = [0.5, 0.9, 0.95]


def length_stats(rows: DataFrame, by: str = "chunk_role", text_col: str = "text", short: int = 50, long: int = 1500) -> DataFrame:
    """Exact length statistics by group from a histogram: lengths are counted first, so ranks need no global sort.

    A percentile is the value at rank round((n - 1) * p), halves to even."""
    lengths = rows.select(by, F.length(strip(F.coalesce(text_col, F.lit("")))).cast("long").alias("len")).groupBy(by, "len").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy("len")
    lengths = lengths.withColumn("through", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("through") > F.bround((F.col("total") - 1) * p), F.col("len"))).alias(f"p{int(p * 100)}")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return lengths.groupBy(by).agg(F.sum("n").alias("count"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 2).alias("mean"), *(at(p) for p in PERCENTILES), F.min("len").alias("min"), F.max("len").alias("max"), some(F.col("len") < short).alias("short"), some(F.col("len") > long).alias("long"))


def _by_each(rows: DataFrame, by: list[str], aggs: list[Column], *more: str) -> DataFrame:
    """aggs of all rows and of each value of each column of `by` (and of `more`), in one pass of grouping sets."""
    extra = [F.col(c) for c in more]
    names = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c) for c in by]
    rows = rows.select(*names, *(c for c in rows.columns if c not in by))
    sets = [extra, *([F.col(c), *extra] for c in by)]
    out = rows.groupingSets(sets, *(F.col(c) for c in by), *extra).agg(*(F.grouping(c).alias(f"_{c}") for c in by), *aggs)
    dimension = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in by), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.col(c)) for c in by), F.lit(""))
    own = [c for c in out.columns if c not in (*by, *(f"_{c}" for c in by))]
    return out.select(dimension.alias("dimension"), value.alias("value"), *own)


def _lengths(rows: DataFrame, by: list[str], text_col: str) -> DataFrame:
    return rows.select(*by, F.length(strip(F.coalesce(text_col, F.lit("")))).cast("long").alias("len"))


def length_histogram(rows: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """(dimension, value, len, n): how many texts have each length."""
    return _by_each(_lengths(rows, by, text_col), by, [F.count("*").alias("n")], "len")


def length_stats_by(rows: DataFrame, by: list[str], text_col: str = "text", short: int = 50, long: int = 1500) -> DataFrame:
    """length_stats of all rows (dimension 'all') and by each of several columns, as (dimension, value, count ...)."""
    lengths = length_histogram(rows, by, text_col)
    group = Window.partitionBy("dimension", "value")
    lengths = lengths.withColumn("through", F.sum("n").over(group.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("through") > F.bround((F.col("total") - 1) * p), F.col("len"))).alias(f"p{int(p * 100)}")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return lengths.groupBy("dimension", "value").agg(F.sum("n").alias("count"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 2).alias("mean"), *(at(p) for p in PERCENTILES), F.min("len").alias("min"), F.max("len").alias("max"), some(F.col("len") < short).alias("short"), some(F.col("len") > long).alias("long"))


#: Size of a quantile sketch; ranks it gives are off by about RANK_ERROR of the count at most, in 99 of 100 cases.
SKETCH_K, RANK_ERROR = 400, 0.01


def length_sketches(rows: DataFrame, by: list[str], text_col: str = "text", short: int = 50, long: int = 1500) -> DataFrame:
    """What a batch stores for the large option: by dimension and value a KLL sketch of the lengths, and exact counts.

    One pass without a histogram: a group of any size is some kilobytes, made in part before the shuffle."""
    n = lambda c: F.count_if(c)
    aggs = [F.kll_sketch_agg_bigint("len", SKETCH_K).alias("sketch"), F.count("*").alias("n"), F.sum("len").alias("total"), F.min("len").alias("min"), F.max("len").alias("max"), n(F.col("len") < short).alias("short"), n(F.col("len") > long).alias("long")]
    return _by_each(_lengths(rows, by, text_col), by, aggs)


def merged_sketches(stored: DataFrame) -> DataFrame:
    """Batches' rows of length_sketches as those of all their rows together."""
    aggs = [F.kll_merge_agg_bigint("sketch", SKETCH_K).alias("sketch"), *(F.sum(c).cast("long").alias(c) for c in ("n", "total")), F.min("min").alias("min"), F.max("max").alias("max"), *(F.sum(c).cast("long").alias(c) for c in ("short", "long"))]
    return stored.groupBy("dimension", "value").agg(*aggs)


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """The columns of length_stats_by: percentiles from the sketch, the rest exact."""
    ps = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(p).cast("double")).alias(f"p{int(p * 100)}") for p in PERCENTILES]
    return sketches.select("dimension", "value", F.col("n").alias("count"), F.round(F.col("total") / F.col("n"), 2).alias("mean"), *ps, "min", "max", "short", "long")


def ingestion_rollup(items: DataFrame) -> DataFrame:
    """Counts of a run as a whole (scope 'all'), by file type, and of failures by stage."""
    good, bad = F.col("status") == "success", F.col("status") == "failed"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    kind, stage = F.coalesce("file_type", F.lit("unknown")).alias("file_type"), F.when(bad, F.coalesce("stage", F.lit("unknown"))).otherwise("").alias("failed_stage")
    rows = items.withColumns({"file_type": kind, "failed_stage": stage})
    out = rows.groupingSets([[], [F.col("file_type")], [F.col("failed_stage")]], F.col("file_type"), F.col("failed_stage")).agg(F.grouping_id("file_type", "failed_stage").alias("gid"), F.count("*").alias("documents"), n(good).alias("succeeded"), n(bad).alias("failed"), F.sum(F.coalesce("block_count", F.lit(0))).alias("blocks"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunks"))
    scope = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "file_type").otherwise("failed_stage")
    value = F.coalesce(F.when(F.col("gid") == 1, F.col("file_type")), F.when(F.col("gid") == 2, F.col("failed_stage")), F.lit(""))
    mean = lambda c: F.when(F.col("succeeded") > 0, F.round(F.col(c) / F.col("succeeded"), 2)).otherwise(0.0)
    return out.select(scope.alias("scope"), value.alias("value"), "documents", "succeeded", "failed", "blocks", "chunks", mean("blocks").alias("mean_blocks"), mean("chunks").alias("mean_chunks")).where("scope <> 'failed_stage' or value <> ''")


#: Fixed timing keys of post-processors whose names hold a word.
TIMING_KEYS = [("rerank", "rerank_ms"), ("automerging", "auto_merge_ms"), ("auto_merging", "auto_merge_ms"), ("parentcontext", "parent_context_ms"), ("parent_context", "parent_context_ms")]


def timing_key(name: Column) -> Column:
    """The key a post-processor's time is summed under: a known one, else its name in lower case and underscores."""
    low = F.lower(name)
    key = F.concat(F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("_ms"))
    for word, known in reversed(TIMING_KEYS):
        key = F.when(low.contains(word), known).otherwise(key)
    return key


def trace_rollup(profiles: DataFrame) -> DataFrame:
    """(timing_key, total_ms, steps) over all calls: the retriever's own time, the whole profiled time (the retriever's
    where a call has none), and that of each post-processor under its key; steps without a key and keys without time are
    left out."""
    core = F.coalesce("retriever_core_ms", F.lit(0.0))
    whole = F.coalesce(F.nullif("retrieval_total_profiled_ms", F.lit(0.0)), core)
    item = lambda key, ms: F.struct(key.alias("timing_key"), ms.cast("double").alias("ms"))
    steps = F.transform(F.coalesce("postprocessors", F.array()), lambda p: item(p["timing_key"], F.coalesce(p["duration_ms"], F.lit(0.0))))
    rows = profiles.select(F.explode(F.concat(F.array(item(F.lit("retriever_core_ms"), core), item(F.lit("retrieval_profiled_ms"), whole)), steps)).alias("p")).where("p.timing_key <> ''")
    return rows.groupBy("p.timing_key").agg(F.round(F.sum("p.ms"), 3).alias("total_ms"), F.count("*").alias("steps")).where("total_ms > 0")


def trace_counts(profiles: DataFrame) -> DataFrame:
    """One row: calls, fallbacks, whether any call used the cache, its hits, and misses of calls that used it."""
    on, hit = (F.coalesce(F.col(f"cache.{c}"), F.lit(False)) for c in ("enabled", "hit"))
    return profiles.agg(F.count("*").alias("calls"), F.count_if(F.coalesce("fallback", F.lit(False))).alias("fallbacks"), F.coalesce(F.bool_or(on), F.lit(False)).alias("cache_enabled"), F.count_if(hit).alias("cache_hits"), F.count_if(on & ~hit).alias("cache_misses"))


def fallback_reasons(profiles: DataFrame) -> DataFrame:
    """(reason, calls) of all calls' reasons."""
    return profiles.select(F.explode("fallback_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("calls"))


def recent_jobs(jobs: DataFrame, n: int = 8) -> DataFrame:
    """One row: of the n latest jobs how many there are, how many wait or run, and how many failed."""
    latest = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)
    return latest.agg(F.count("*").alias("recent_total"), F.count_if(F.col("status").isin("pending", "running")).alias("running"), F.count_if(F.col("status") == "failed").alias("failed"))


def library_overview(library: DataFrame) -> DataFrame:
    """One row: documents, indexed, pending, bytes and the sorted types."""
    return library.agg(F.count("*").alias("documents"), F.count_if(F.col("index_status") == "indexed").alias("indexed"), F.count_if(F.col("index_status") != "indexed").alias("pending"), F.sum("file_size").alias("bytes"), F.array_join(F.sort_array(F.collect_set("file_type")), ",").alias("types"))


def chunk_index(nodes: DataFrame, level: Column, ordinal: Column) -> DataFrame:
    """0-based position of each node inside its document, by level and ordinal."""
    return nodes.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(level, ordinal, "chunk_id")) - 1)


def merge_sections(sections: DataFrame, most_ranges: int = 20) -> DataFrame:
    """(doc_id, text, section_count, page_ranges): a document's sections in order, under '## title' where the text
    doesn't begin with it; the first distinct page ranges."""
    heading = F.concat(F.lit("## "), F.col("section_title"))
    body = strip(F.coalesce("text", F.lit("")))
    text = F.when((F.coalesce("section_title", F.lit("")) != "") & ~body.startswith(heading), F.concat(heading, F.lit("\n"), body)).otherwise(body)
    rows = sections.select("doc_id", "section_index", text.alias("t"), "page_range")
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "t", "page_range"))).alias("s"), F.count("*").alias("section_count"))
    ranges = F.slice(F.array_distinct(F.filter(F.transform("s", lambda x: F.coalesce(x["page_range"], F.lit(""))), lambda x: x != "")), 1, most_ranges)
    return got.select("doc_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"), "section_count", F.array_join(ranges, ",").alias("page_ranges"))

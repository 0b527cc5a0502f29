"""Relevance judgements, matching of hits to gold evidence, and retrieval metrics by slice."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.functions.tables import written
from granary.functions.text import BLANK, char_grams, filled, normalize_path, overlap_of, page_numbers, strip
from granary.sources.parsing import slices

#: Fixed value: the cut-offs that metrics are reported at.
CUTS = [1, 3, 5, 10]


def evidence_anchors(questions: DataFrame) -> DataFrame:
    """(query_id, anchor_id, gold_file, gold_page): files and pages zipped where they are as many, else crossed; files
    alone without pages."""
    files, pages = F.col("gold_files"), F.coalesce("gold_pages", F.array().cast("array<int>"))
    named = lambda i: F.concat(F.lit("a"), (i + 1).cast("string"))
    anchor = lambda name, f, p: F.struct(name.alias("anchor_id"), f.alias("gold_file"), p.alias("gold_page"))
    none = F.lit(None).cast("int")
    zipped = F.transform(files, lambda f, i: anchor(named(i), f, F.get(pages, i)))
    crossed = F.flatten(F.transform(files, lambda f, i: F.transform(pages, lambda p: anchor(F.concat(named(i), F.lit("_p"), p.cast("string")), f, p))))
    alone = F.transform(files, lambda f, i: anchor(named(i), f, none))
    each = F.when((F.size(pages) > 0) & (F.size(pages) == F.size(files)), zipped).when(F.size(pages) > 0, crossed).otherwise(alone)
    return questions.select("query_id", F.inline(each))


def path_matches(a: Column, b: Column) -> Column:
    """Equal, or one ends with the other at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def match_hits_to_anchors(hits: DataFrame, questions: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(query_id, rank, chunk_id, matched, match_type, overlap, anchor_ids).

    An anchor of the hit's file matches by page, without a page of its own, or by text overlap; where no file matches,
    an overlap of max(0.75, threshold) matches as text_overlap. Gram sets are made once a text, before the join."""
    anchors = evidence_anchors(questions).withColumn("gold_file", normalize_path(F.col("gold_file")))
    golds = questions.select("query_id", char_grams(F.col("gold_evidence")).alias("gold_grams"))
    rows = hits.select("query_id", "rank", "chunk_id", normalize_path(F.col("source_path")).alias("path"), page_numbers(F.col("page_range")).alias("pages"), char_grams(F.col("text")).alias("grams"))
    rows = rows.join(golds, "query_id").withColumn("overlap", overlap_of(F.col("gold_grams"), F.col("grams"))).drop("gold_grams", "grams")
    pairs = rows.join(anchors, "query_id", "left")
    file_hit = F.coalesce((F.col("path") != "") & path_matches(F.col("path"), F.col("gold_file")), F.lit(False))
    page_hit = F.coalesce(F.array_contains("pages", F.col("gold_page")), F.lit(False))
    hit = file_hit & (page_hit | F.col("gold_page").isNull() | (F.col("overlap") >= threshold))
    got = pairs.groupBy("query_id", "rank", "chunk_id", "overlap").agg(
        F.array_sort(F.collect_set(F.when(hit, F.col("anchor_id")))).alias("anchor_ids"),
        F.bool_or(file_hit).alias("any_file"),
        F.bool_or(page_hit).alias("any_page"),
        F.bool_or(F.coalesce(F.col("gold_page") != 0, F.lit(False))).alias("has_pages"),
    )
    found = F.size("anchor_ids") > 0
    wild = ~found & ~F.col("any_file") & (F.col("overlap") >= max(0.75, threshold))
    kind = F.when(found & F.col("any_page"), "file_page").when(found & F.col("any_file") & ~F.col("has_pages"), "file_only").when(found, "file_text_overlap").when(wild, "text_overlap").otherwise("")
    ids = F.when(wild, F.array(F.lit("text_overlap"))).otherwise(F.col("anchor_ids"))
    return got.select("query_id", "rank", "chunk_id", (found | wild).alias("matched"), kind.alias("match_type"), "overlap", ids.alias("anchor_ids"))


def match_hits_to_qrels(hits: DataFrame, qrels: DataFrame, id_cols: list[str] | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, matched, evidence_ids): a hit matches evidence of which any of its ids is positive."""
    ids = F.array_distinct(F.array_compact(F.array(*(filled(F.col(c)) for c in id_cols or ["chunk_id", "parent_id"]))))
    flat = hits.select("query_id", "rank", "chunk_id", F.explode(ids).alias("node_id"))
    found = flat.join(qrels.select("query_id", "node_id", "evidence_id").distinct(), ["query_id", "node_id"]).groupBy("query_id", "rank", "chunk_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    out = hits.select("query_id", "rank", "chunk_id").join(found, ["query_id", "rank", "chunk_id"], "left")
    return out.select("query_id", "rank", "chunk_id", F.col("evidence_ids").isNotNull().alias("matched"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


#: Characters of evidence that are held at a time, and nodes that are scored at a time.
BLOCK_CHARS, NODE_SLICE = 16_000_000, 256


def _packed_grams(text: str) -> np.ndarray:
    """The distinct character trigrams of a text without white space as numbers, 21 bits a character; a shorter text is
    one gram, an empty one none."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    if len(codes) < 3:  # its high bits are empty, so it is never a trigram
        return np.array([sum(int(c) << 21 * i for i, c in enumerate(codes))], np.int64)[: len(codes)]
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])


def gram_overlaps(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """(id, overlap double) of each pair of texts: what text.evidence_overlap gives, from grams packed as numbers, so a
    text's grams are made once and none is a row or a string. Grams are compared as their characters, not by hash."""
    flat = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"{BLANK}+", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = _packed_grams(x), _packed_grams(y)
                least = min(len(x), len(y))
                out.append(len(np.intersect1d(x, y, assume_unique=True)) / least if least else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], [id_col, "overlap"])

    return pairs.select(id_col, flat(a), flat(b)).mapInArrow(run, f"{id_col} {pairs.schema[id_col].dataType.simpleString()}, overlap double")


def best_nodes(evidence: DataFrame, nodes: DataFrame, top_n: int = 3, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(query_id, evidence_id, node_id, parent_id, score): of each evidence, the top_n nodes of its path with the largest
    overlap of character trigrams above 0; ties by node_id.

    Evidences are the query set: blocks of about block_chars characters, dealt by hash, are broadcast one after the
    other as lists of the evidences that have a gram. Each task counts, for a few nodes at a time, the grams they share
    with every evidence of their path, and keeps a running top_n of each evidence; only those rows are shuffled. At a
    threshold of 0.25 nearly every pair of texts shares enough trigrams to pass a prefix filter, so pairs are neither
    made as rows nor filtered. A gram is compared as its characters, not by hash."""
    flat = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"{BLANK}+", ""))
    asked = written(evidence.select("query_id", "evidence_id", "path", flat("evidence_text").alias("x")).where("path is not null and x <> ''"), "qrels-evidence")
    chars = asked.agg(F.coalesce(F.sum(F.length("x")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-chars // block_chars))
    rows = nodes.select("node_id", "parent_id", "path", flat("text").alias("x")).where("path is not null and x <> ''")
    ids = [asked.schema[c].dataType.simpleString() for c in ("query_id", "evidence_id")]
    schema = f"query_id {ids[0]}, evidence_id {ids[1]}, node_id string, parent_id string, score double"
    part = lambda i: asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", "evidence_id"), F.lit(blocks)) == i)
    found = [_best_of_block(part(i), rows, top_n, schema) for i in range(blocks)]
    if blocks > 1:  # each block is done before the next one is held
        found = [written(x, "qrels-block") for x in found]
    place = F.row_number().over(Window.partitionBy("query_id", "evidence_id").orderBy(F.desc("score"), "node_id"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= top_n)


def _best_of_block(asked: DataFrame, rows: DataFrame, top_n: int, schema: str) -> DataFrame:
    held = asked.toPandas()
    paths = {}  # by path: evidence rows, their numbers of grams, and sorted (gram, evidence) postings
    for path, own in held.groupby("path"):
        grams = [_packed_grams(x) for x in own["x"]]
        sizes = np.array([len(g) for g in grams])
        flat, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
        order = np.argsort(flat, kind="stable")
        paths[path] = (own.index.to_numpy(), sizes, flat[order], owner[order])
    kinds = [*(to_arrow_type(asked.schema[c].dataType) for c in ("query_id", "evidence_id")), pa.string(), pa.string(), pa.float64()]
    shared = rows.sparkSession.sparkContext.broadcast((held["query_id"].tolist(), held["evidence_id"].tolist(), paths))

    def scores(texts: list[str], sizes: np.ndarray, flat: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), len(sizes)))
        for i, text in enumerate(texts):
            own = _packed_grams(text)
            begin, end = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
            n = end - begin
            met = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[i] = np.bincount(owner[met], minlength=len(sizes)) / np.minimum(sizes, len(own))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names, paths = shared.value
        kept: dict = {}  # by path: scores, node ids and parents, top_n rows of a column an evidence
        for batch in batches:
            for at in range(0, batch.num_rows, NODE_SLICE):
                node, parent, path, text = (c.to_pylist() for c in batch.slice(at, NODE_SLICE).columns)
                groups: dict = {}
                for i in sorted(range(len(node)), key=lambda i: node[i]):
                    if path[i] in paths:
                        groups.setdefault(path[i], []).append(i)
                for p, own in groups.items():
                    found = scores([text[i] for i in own], *paths[p][1:])
                    best = np.argsort(-found, axis=0, kind="stable")[:top_n]
                    new = [np.take_along_axis(found, best, 0), *(np.array([x[i] or "" for i in own], dtype="U")[best] for x in (node, parent))]
                    if p in kept:
                        new = [np.concatenate(x) for x in zip(kept[p], new)]
                        best = np.lexsort((new[1], -new[0]), axis=0)[:top_n]
                        new = [np.take_along_axis(x, best, 0) for x in new]
                    kept[p] = new
        for p, (score, node, parent) in kept.items():
            place, own = np.nonzero(score > 0)
            evidence = paths[p][0][own]
            columns = [[queries[i] for i in evidence], [names[i] for i in evidence], node[place, own].tolist(), [x or None for x in parent[place, own].tolist()], score[place, own]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "evidence_id", "node_id", "parent_id", "score"])

    return rows.mapInArrow(run, schema)


def build_node_qrels(evidence: DataFrame, nodes: DataFrame, threshold: float = 0.25, top_n: int = 3, best: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence_id, node_id, relevance, qrel_role, match_score).

    Of each evidence's nodes of the same path, the top_n of at least threshold, else the best one; the first is primary
    with relevance 2, others are secondary with 1. Each gives a row for its own and for its parent's id; where ids meet,
    the better row stays. best may give best_nodes' rows, where they are at hand."""
    rows = best_nodes(evidence, nodes, top_n) if best is None else best
    kept = rows.where((F.col("place") == 1) | (F.col("score") >= threshold))
    flat = kept.select("query_id", "evidence_id", "place", F.col("score").alias("match_score"), F.explode(F.array_distinct(F.array_compact(F.array(F.col("node_id"), filled(F.col("parent_id")))))).alias("node_id"))
    ranked = flat.groupBy("query_id", "evidence_id", "node_id").agg(F.min("place").alias("place"), F.max("match_score").alias("match_score"))
    first = F.col("place") == 1
    return ranked.select("query_id", "evidence_id", "node_id", F.when(first, 2).otherwise(1).alias("relevance"), F.when(first, "primary").otherwise("secondary").alias("qrel_role"), "match_score")


def node_qrels_diagnostics(evidence: DataFrame, nodes: DataFrame, threshold: float = 0.25, top_n: int = 3, best: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence_id, path, candidate_count, selected_count, best_score, used_fallback_best), a row an evidence:
    nodes of its path, how many were selected, the best score, and whether that one stands in for lack of any at the
    threshold."""
    rows = best_nodes(evidence, nodes, top_n) if best is None else best
    at = F.count_if(F.col("score") >= threshold)
    got = rows.groupBy("query_id", "evidence_id").agg(F.greatest(at, F.lit(1)).alias("selected_count"), F.round(F.max("score"), 4).alias("best_score"), (at == 0).alias("used_fallback_best"))
    counts = nodes.where("path is not null and path <> ''").groupBy("path").agg(F.count("*").alias("candidate_count"))
    out = evidence.select("query_id", "evidence_id", "path").join(counts, "path", "left").join(got, ["query_id", "evidence_id"], "left")
    zero = {"candidate_count": 0, "selected_count": 0, "best_score": 0.0, "used_fallback_best": False}
    return out.select("query_id", "evidence_id", "path", *zero).na.fill(zero)


def node_qrels_summary(qrels: DataFrame, diagnostics: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: node_count, question_count, qrel_row_count, unmapped_evidence_count, fallback_best_count."""
    counts = diagnostics.agg(F.countDistinct("query_id").alias("question_count"), F.count_if(F.col("selected_count") == 0).alias("unmapped_evidence_count"), F.count_if("used_fallback_best").alias("fallback_best_count"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # noqa: E731  a row each
    return counts.crossJoin(one(nodes, "node_count")).crossJoin(one(qrels, "qrel_row_count"))


def metrics_at_k(hits: DataFrame, gold: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """(query_id, hit_k, recall_k, precision_k, mrr_k ...) of ranked ids against gold ids; one row a query with gold."""
    golds = gold.select("query_id", "gold_id").distinct()
    sizes = golds.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    rows = hits.select("query_id", "chunk_id", "rank").join(golds.withColumnRenamed("gold_id", "chunk_id"), ["query_id", "chunk_id"])
    aggs = []
    for k in cuts or CUTS:
        inside = F.col("rank") <= k
        aggs += [F.countDistinct(F.when(inside, F.col("chunk_id"))).alias(f"n_{k}"), F.min(F.when(inside, F.col("rank"))).alias(f"first_{k}")]
    got = sizes.join(rows.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = ["query_id", "n_gold"]
    for k in cuts or CUTS:
        n = F.coalesce(f"n_{k}", F.lit(0))
        out += [(n > 0).cast("double").alias(f"hit_{k}"), (n / F.col("n_gold")).alias(f"recall_{k}"), (n / k).alias(f"precision_{k}"), F.coalesce(1 / F.col(f"first_{k}"), F.lit(0.0)).alias(f"mrr_{k}")]
    return got.select(*out)


def anchor_metrics_at_k(matches: DataFrame, anchor_counts: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """One row a query: hit, evidence recall (1 where text_overlap is inside k), all-evidence hit and MRR at each k,
    and the rank of the first match."""
    flat = matches.where("matched").select("query_id", "rank", F.explode_outer("anchor_ids").alias("anchor_id"))
    aggs = [F.min("rank").alias("first_hit_rank")]
    for k in cuts or CUTS:
        inside = F.col("rank") <= k
        aggs += [F.countDistinct(F.when(inside, F.col("anchor_id"))).alias(f"n_{k}"), F.bool_or(inside & (F.col("anchor_id") == "text_overlap")).alias(f"wild_{k}")]
    got = anchor_counts.select("query_id", "anchors").join(flat.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = ["query_id", "first_hit_rank"]
    for k in cuts or CUTS:
        first = F.coalesce(F.col("first_hit_rank") <= k, F.lit(False))
        recall = F.when(F.col("anchors") <= 0, 0.0).when(F.coalesce(f"wild_{k}", F.lit(False)), 1.0).otherwise(F.coalesce(f"n_{k}", F.lit(0)) / F.col("anchors"))
        out += [first.cast("double").alias(f"hit_{k}"), recall.alias(f"recall_{k}"), (recall >= 1).cast("double").alias(f"all_{k}"), F.when(first, 1 / F.col("first_hit_rank")).otherwise(0.0).alias(f"mrr_{k}")]
    return got.select(*out)


def eval_summary(details: DataFrame, metrics: list[str], slices: tuple[str, str] = ("difficulty", "question_type")) -> DataFrame:
    """Means by strategy, and by strategy and each slice, in one pass of grouping sets."""
    a, b = (F.col(x) for x in slices)
    strategy = F.col("strategy")
    aggs = [F.count("*").alias("questions"), F.sum(F.when(F.col("error") != "", 1).otherwise(0)).alias("errors"), F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"), *(F.round(F.avg(m), 4).alias(m) for m in metrics), F.avg("first_hit_rank").alias("mean_first_hit_rank")]
    out = details.groupingSets([[strategy], [strategy, a], [strategy, b]], strategy, a, b).agg(F.grouping_id(strategy, a, b).alias("gid"), *aggs)
    slice_name = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, slices[0]).otherwise(slices[1])
    return out.select("strategy", slice_name.alias("slice"), F.coalesce(F.when(F.col("gid") == 1, a), F.when(F.col("gid") == 2, b), F.lit("")).alias("slice_value"), "questions", "errors", "mean_latency_ms", *metrics, "mean_first_hit_rank")


def match_type_counts(matches: DataFrame) -> DataFrame:
    return matches.where("matched").groupBy("strategy", "match_type").agg(F.count("*").alias("hits"))


#: Fixed values of the audit: types of question that must name a unit, the word that does, the name of what is not set.
UNIT_TYPES, UNIT_WORD, NOT_SET = ["table_numeric", "hard_negative_table_numeric"], "单位", "unknown"


def eval_set_audit(questions: DataFrame) -> DataFrame:
    """One row: questions, distinct ones, texts that occur more than once (as they stand), questions with several
    evidences, abstentions, those without contexts, and those of a numeric type that name no unit.

    Equal texts are counted by their SHA-256, so no whole text is shuffled; a null question is an empty one."""
    asked = F.coalesce("question", F.lit(""))
    once = questions.groupBy(F.sha2(asked, 256)).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct_questions"), F.count_if(F.col("n") > 1).alias("duplicated"))
    contexts = F.coalesce("n_contexts", F.lit(0))
    counts = questions.agg(F.count("*").alias("questions"), F.count_if(contexts > 1).alias("multi_evidence"), F.count_if(F.col("eval_type") == "abstention").alias("abstentions"), F.count_if(contexts == 0).alias("missing_contexts"), F.count_if(F.col("question_type").isin(UNIT_TYPES) & ~asked.contains(UNIT_WORD)).alias("numeric_without_unit"))
    return counts.crossJoin(F.broadcast(once))  # a row each


def eval_set_counts(questions: DataFrame) -> DataFrame:
    """(slice, value, questions) by question type and by difficulty."""
    named = questions.select(F.explode(F.array(*(F.struct(F.lit(c).alias("slice"), F.coalesce(F.nullif(c, F.lit("")), F.lit(NOT_SET)).alias("value")) for c in ("question_type", "difficulty")))).alias("s"))
    return named.groupBy("s.slice", "s.value").agg(F.count("*").alias("questions"))


def answer_metric_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric's numeric values, rounded to 4 places; others are ignored."""
    one = lambda m: scores.select(F.lit(m).alias("metric"), F.col(m).cast("string").try_cast("double").alias("v")).groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"))
    return reduce(DataFrame.unionByName, (one(m) for m in metrics))


def lowest_answers(scores: DataFrame, metric: str, id_col: str, n: int = 5) -> DataFrame:
    """The n rows of lowest metric, those without a number last."""
    return scores.withColumn("v", F.col(metric).cast("string").try_cast("double")).orderBy(F.asc_nulls_last("v"), id_col).limit(n)


def build_answer_eval_set(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Questions with their contexts in rank order; (user_input, response, retrieved_contexts, reference, source_count)
    and whether there is a response to evaluate."""
    ordered = contexts.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda x: x["text"]).alias("retrieved_contexts"))
    rows = questions.join(ordered, "query_id", "left")
    texts = F.coalesce("retrieved_contexts", F.array().cast("array<string>"))
    return rows.select("query_id", F.col("question").alias("user_input"), "response", texts.alias("retrieved_contexts"), F.col("answer").alias("reference"), F.size(texts).cast("long").alias("source_count"), filled(F.col("response")).isNotNull().alias("usable"))


def _text_of(value: Column) -> Column:
    """A JSON value as the text that it is read as: numbers and strings as they stand, null and nothing-values empty."""
    text = F.try_variant_get(value, "$", "string")
    return strip(F.coalesce(F.when(text.isin("0", "0.0", "false"), "").when(text == "true", "True").otherwise(text), F.lit("")))


def grounding_score(payloads: DataFrame) -> DataFrame:
    """(answer_id, grounding_score, verdict, unsupported): claims weigh 1, 0.5, 0, 0; a contradiction fails, 0.8 passes,
    0.5 warns. Verdicts other than the four count as unsupported. No claims score 0.

    A payload is parsed as it is, whatever its shape: claims that are no list, and entries of it that are no objects,
    count as absent; a number stands for its text; other keys don't matter. What is no JSON has no claims."""
    claims = F.try_variant_get(F.try_parse_json("payload"), "$.claims", "array<variant>")
    item = lambda k: F.try_variant_get("c", f"$.{k}", "variant")
    rows = payloads.select("answer_id", F.explode_outer(claims).alias("c"))
    real = F.coalesce(F.schema_of_variant("c").startswith("OBJECT"), F.lit(False))
    said = F.lower(_text_of(item("verdict")))
    rows = rows.select("answer_id", real.alias("real"), F.when(said.isin("supported", "partial", "contradicted"), said).otherwise("unsupported").alias("verdict"), _text_of(item("claim")).alias("claim"))
    weight = F.when(F.col("verdict") == "supported", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    poor = F.col("verdict").isin("unsupported", "contradicted") & (F.col("claim") != "")
    got = rows.groupBy("answer_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("real"), weight)), F.lit(0.0)), 4).alias("grounding_score"), F.bool_or(F.col("real") & (F.col("verdict") == "contradicted")).alias("contradicted"), F.array_sort(F.collect_list(F.when(F.col("real") & poor, F.col("claim")))).alias("unsupported"))
    verdict = F.when(F.col("contradicted"), "fail").when(F.col("grounding_score") >= 0.8, "pass").when(F.col("grounding_score") >= 0.5, "warning").otherwise("fail")
    return got.select("answer_id", "grounding_score", verdict.alias("verdict"), "unsupported")

"""Metadata contracts, golden questions and prompt texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import base_name, collapse, contains_any, filled, first_filled, strip, to_decimal

#: Fixed aliases of each metadata field, first filled one wins; roles a chunk may have.
ALIASES = {"doc_id": ["doc_id", "document_id", "ref_doc_id"], "source_path": ["source_path", "file_path", "path"], "chunk_id": ["chunk_id", "node_id", "id"], "parent_id": ["parent_id", "parent"], "page_range": ["page_range", "page_label", "page"], "section_title": ["section_title", "title"]}
ROLES = ["root", "parent", "leaf"]
#: Fixed word lists of the report reader.
SHORT_REPORTS = ["摘要", "英文"]
NUMBER = r"^-?\d{1,3}(?:,\d{3})*(?:\.\d+)?%?$|^-?\d+(?:\.\d+)?%?$"
NOT_APPLICABLE, CHANGES = "不适用", ["减少", "增加"]


def canonical_metadata(m: Column) -> Column:
    """A struct of the known fields of a loose map; file_name falls back to the path's, then doc_id, then a fixed name."""
    fields = {name: first_filled(*(m[k] for k in keys)) for name, keys in ALIASES.items()}
    role = F.lower(first_filled(m["chunk_role"], m["role"]))
    name = first_filled(m["file_name"], base_name(F.nullif(fields["source_path"], F.lit(""))), fields["doc_id"], F.lit("unknown_file"))
    return F.struct(*(v.alias(k) for k, v in fields.items()), name.alias("file_name"), F.when(role.isin(ROLES), role).otherwise("unknown").alias("chunk_role"))


def source_payload(m: Column, text: Column, score: Column) -> Column:
    """The fields of a hit as it is shown, of its map, text and score. A parent's path, title and pages come before its
    own, a child's id before the chunk's, a mode before the role; what is missing is '', a number that doesn't parse null."""
    meta, first = canonical_metadata(m), lambda *keys: first_filled(*(m[k] for k in keys))
    fields = {
        "text": F.coalesce(text, F.lit("")),
        "score": score.cast("double"),
        **{k: meta[k] for k in ("doc_id", "file_name", "source_path", "chunk_id")},
        "retrieval_mode": first("retrieval_mode", "chunk_role"),
        "parent_id": meta["parent_id"],
        "parent_source_path": first_filled(m["parent_source_path"], meta["source_path"]),
        "parent_section_title": first("parent_section_title", "section_title"),
        "parent_page_range": first("parent_page_range", "page_range"),
        "child_chunk_id": first("child_chunk_id", "chunk_id"),
        "table_id": first("table_id"),
        "table_page_range": first("table_page_range"),
        "auto_merged": F.coalesce(F.lower(strip(m["auto_merged"])).isin("true", "1"), F.lit(False)),
        "merge_ratio": strip(m["merge_ratio"]).try_cast("double"),
        **{k: strip(m[k]).try_cast("int") for k in ("merged_child_count", "total_child_count")},
    }
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def source_label(file_name: Column, path: Column, pages: Column, section: Column, chunk: Column) -> Column:
    part = lambda name, v: F.concat(F.lit(f"{name}="), filled(v))
    label = F.concat_ws("；", F.coalesce(part("文档", file_name), part("路径", path)), part("页码", pages), part("章节", section), part("chunk", chunk))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("未知来源"))


def gold_ids(paragraphs: list[Column], documents: list[Column]) -> Column:
    """Distinct gold ids in order, of paragraphs if any is filled, else of documents."""
    flat = lambda arrays: F.array_distinct(F.filter(F.transform(F.flatten(F.array(*arrays)), strip), lambda x: x != ""))
    return F.when(F.size(flat(paragraphs)) > 0, flat(paragraphs)).otherwise(flat(documents))


def dedupe_query_batch(requests: DataFrame, id_col: str, text_col: str, top_k: int) -> DataFrame:
    """Adds norm, cache_key (of query and settings), asked (how often) and runs (true for the first of each key)."""
    norm = collapse(F.lower(F.col(text_col)))
    keyed = requests.withColumn("norm", norm).withColumn("cache_key", F.sha2(F.to_json(F.struct(F.col("norm").alias("query"), F.lit(top_k).alias("top_k"))), 256))
    first = keyed.groupBy("cache_key").agg(F.min(id_col).alias("first_id"), F.count("*").alias("asked"))
    return keyed.join(first, "cache_key").withColumn("runs", F.col(id_col) == F.col("first_id")).drop("first_id")


def fan_back(requests: DataFrame, results: DataFrame, id_col: str) -> DataFrame:
    """Every request of dedupe_query_batch with the result rows of the one of its key that ran, whose id is served_by.
    results are rows of the ids that ran; a request whose run gave none has one row without values."""
    ran = requests.where("runs").select("cache_key", F.col(id_col).alias("served_by"))
    return requests.join(ran, "cache_key").join(results.withColumnRenamed(id_col, "served_by"), "served_by", "left")


def filing_year(filed: Column) -> Column:
    """The year a filing's date begins with; a fixed name where there is no date."""
    return F.coalesce(F.nullif(F.substring(F.coalesce(filed, F.lit("")), 1, 4), F.lit("")), F.lit("unknown_year"))


def filing_path(ticker: Column, form: Column, year: Column, accession: Column, document: Column) -> Column:
    """Where a filing's main document is kept, below the collection's folder."""
    return F.concat_ws("/", F.lit("filings"), ticker, F.translate(form, " /", "__"), year, F.concat(accession, F.lit("_"), document))


def explode_filings(index: DataFrame, columns: list[str], forms: list[str], most: int) -> DataFrame:
    """Columnar filing arrays as rows, up to the shortest array; the wanted forms, the first `most` of each."""
    shortest = F.least(*(F.size(c) for c in columns))
    flat = index.select("ticker", shortest.alias("n"), F.posexplode(F.arrays_zip(*columns)).alias("pos", "f")).where("pos < n").select("ticker", "pos", "f.*")
    flat = flat.where(F.col("form").isin(forms)).withColumn("nth", F.row_number().over(Window.partitionBy("ticker", "form").orderBy("pos")))
    return flat.where(F.col("nth") <= most).drop("nth", "pos")


def cross_doc_metrics(annual: DataFrame, quarterly: DataFrame) -> DataFrame:
    return annual.select("ticker", F.col("amount").alias("annual")).join(quarterly.select("ticker", F.col("amount").alias("quarterly")), "ticker")


def cross_entity_pairs(metrics: DataFrame, most: int) -> DataFrame:
    """Pairs of entities in order, at most `most` in all: how the first one's amount compares if the units are equal.

    Only the first entities can take part in the first pairs, so as many as needed are paired, not all."""
    few = metrics.orderBy("ticker").limit(most + 1)
    a = few.select(F.col("ticker").alias("left_ticker"), F.col("unit").alias("lu"), to_decimal(F.col("amount").cast("string")).alias("la"))
    b = few.select(F.col("ticker").alias("right_ticker"), F.col("unit").alias("ru"), to_decimal(F.col("amount").cast("string")).alias("ra"))
    relation = F.when(F.col("lu") != F.col("ru"), "not comparable").when(F.col("la") > F.col("ra"), "higher").when(F.col("la") < F.col("ra"), "lower").otherwise("equal")
    return a.join(b, F.col("left_ticker") < F.col("right_ticker")).select("left_ticker", "right_ticker", relation.alias("relation")).orderBy("left_ticker", "right_ticker").limit(most)


def first_full_report(reports: DataFrame, by: list[str], path_col: str) -> DataFrame:
    """The first report in path order of each group, abstracts and foreign versions left out."""
    kept = reports.where(~contains_any(F.col(path_col), SHORT_REPORTS))
    return kept.groupBy(*by).agg(F.min(path_col).alias(path_col))


def first_page_with(pages: DataFrame, groups: list[list[str]], most_page: int) -> DataFrame:
    """(doc_id, page_no, text) of the first page up to most_page that has a word of each group."""
    holds = reduce(lambda a, b: a & b, (contains_any(F.col("text"), g) for g in groups))
    return pages.where(holds & (F.col("page_no") <= most_page)).groupBy("doc_id").agg(F.min("page_no").alias("page_no"), F.min_by("text", "page_no").alias("text"))


def labelled_values(lines: DataFrame, labels: list[str], reach: int = 18) -> DataFrame:
    """(doc_id, found): values on the `reach` lines after the first line that has a label and any value after it."""
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, reach)
    line = strip(F.col("line"))
    value = F.when(line.rlike(NUMBER) | (line == NOT_APPLICABLE) | contains_any(line, CHANGES), line)
    rows = lines.withColumn("found", F.collect_list(value).over(after)).where(contains_any(F.col("line"), labels) & (F.size("found") > 0))
    return rows.groupBy("doc_id").agg(F.min_by("found", "pos").alias("found"))


def value_after_label(lines: DataFrame, label: str, skip: list[str] | None = None, reach: int = 7) -> DataFrame:
    """(doc_id, value): of the first line with the label that has one, what else stands on the line, or the first of the
    `reach` lines after it; values to skip don't count."""
    kept = lambda c: ~c.isin(skip) if skip else F.lit(True)
    line = strip(F.col("line"))
    after = F.first(F.when(kept(line), line), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, reach))
    rest = strip(F.replace(line, F.lit(label), F.lit("")))
    rows = lines.withColumn("value", F.coalesce(F.when((rest != "") & kept(rest), rest), after)).where(line.contains(label) & F.col("value").isNotNull())
    return rows.groupBy("doc_id").agg(F.min_by("value", "pos").alias("value"))


def snippet_around_label(lines: DataFrame, labels: list[str], window: int = 10, before: int = 2) -> DataFrame:
    """(doc_id, snippet): the lines around the first that has a label, else the document's first lines."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    around = lambda n: F.collect_list("line").over(order.rowsBetween(n, window - 1))
    has = contains_any(F.col("line"), labels)
    rows = lines.select("doc_id", "pos", has.alias("has"), around(-before).alias("near"), around(0).alias("from_here"))
    got = rows.groupBy("doc_id").agg(F.min_by(F.when(F.col("has"), F.col("near")), F.when(F.col("has"), F.col("pos"))).alias("near"), F.min_by("from_here", "pos").alias("first"))
    return got.select("doc_id", strip(F.array_join(F.coalesce("near", "first"), "\n")).alias("snippet"))


def eval_bundle(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, qrels and the evidence catalogue (of equal ids the first question's text)."""
    flat = questions.select("id", F.posexplode("positive_contexts").alias("pos", "c")).select(F.col("id").alias("query_id"), "pos", "c.*")
    catalogue = flat.groupBy("evidence_id").agg(F.min_by("evidence_text", F.struct("query_id", "pos")).alias("evidence_text"))
    return questions.select("id", "question"), flat.select("query_id", "evidence_id"), catalogue


def bundle_counts(queries: DataFrame, qrels: DataFrame, evidence: DataFrame) -> DataFrame:
    """The manifest: rows of each part."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in (("queries", queries), ("qrels", qrels), ("evidence", evidence))))

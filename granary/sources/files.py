"""File sources and sinks: collections, question files, judgements, section audits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from granary.functions.tables import work_dir  # noqa: F401
from granary.functions.text import filled, strip
from granary.operators.blocks import ordered_text
from granary.operators.rollups import ingestion_rollup

#: Fixed list of the file types that are taken in.
SUFFIXES = [".txt", ".md", ".markdown", ".pdf", ".docx", ".html", ".htm"]
QUESTION = "id string, question string, answer string, gold_files string, gold_pages string, gold_evidence string, difficulty string, question_type string"


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, file_type, file_size, mtime, content) of all files below root of the known types. content is
    read only where it is selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select("path", name.alias("file_name"), suffix.alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), "content").where(F.col("file_type").isin(SUFFIXES))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of questions; files and pages may be one value or a list. Rows without question or file are dropped."""
    rows = spark.read.schema(QUESTION).json(path)
    listed = lambda c, kind: F.coalesce(F.when(F.col(c).startswith("["), F.from_json(c, f"array<{kind}>")), F.when(filled(F.col(c)).isNotNull(), F.array(F.col(c).try_cast(kind))))
    files = F.filter(F.coalesce(listed("gold_files", "string"), F.array().cast("array<string>")), lambda x: strip(x) != "")
    pages = F.array_compact(F.coalesce(listed("gold_pages", "int"), F.array().cast("array<int>")))
    rows = rows.select("id", strip(F.col("question")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), files.alias("gold_files"), pages.alias("gold_pages"), F.coalesce("gold_evidence", F.lit("")).alias("gold_evidence"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
    return rows.where((F.col("question") != "") & (F.size("gold_files") > 0))


def read_qrels(spark: SparkSession, path: str, role: str = "any", least_relevance: int = 1) -> DataFrame:
    """(query_id, evidence_id, node_ids) of a TSV of judgements; missing columns get the node's id, 1 and any role."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if missing := {"query_id", "node_id"}.difference(rows.columns):
        raise ValueError(f"judgements without {sorted(missing)}")
    rows = rows.withColumn("evidence_id", F.col("evidence_id") if "evidence_id" in rows.columns else F.col("node_id"))
    relevance = F.coalesce(F.col("relevance").try_cast("double"), F.lit(1.0)).cast("int") if "relevance" in rows.columns else F.lit(1)
    rows = rows.where(relevance >= least_relevance)
    if role != "any" and "qrel_role" in rows.columns:
        rows = rows.where(F.col("qrel_role") == role)
    whole = rows.where("query_id <> '' and evidence_id <> '' and node_id <> ''")
    return whole.groupBy("query_id", "evidence_id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def sections_to_markdown(sections: DataFrame) -> DataFrame:
    """(doc_id, markdown): each section under '## Section n' with its fields in a fenced block."""
    field = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = F.concat(F.lit("## Section "), F.col("section_index").cast("string"), F.lit("\n\n```\n"), F.concat_ws("\n", field("section_title"), field("page_range"), field("element_type")), F.lit("\n```\n\n"))
    return ordered_text(sections, "doc_id", "section_index", F.concat(head, strip(F.coalesce("text", F.lit("")))), "markdown", "\n\n---\n\n")


def read_section_audit(audits: DataFrame) -> DataFrame:
    """Section rows of audit Markdown (doc_id, markdown): the inverse of sections_to_markdown."""
    parts = audits.select("doc_id", F.explode(F.split("markdown", r"(?m)(?:\n\n---\n\n)?^## Section (?=\d+\n\n```\n)")).alias("part")).where("part rlike '^[0-9]+\\n'")
    block = F.regexp_extract("part", r"(?s)^\d+\n\n```\n(.*?)\n```\n\n", 1)
    field = lambda c: F.nullif(F.regexp_extract(block, rf"(?m)^{c}: (.*)$", 1), F.lit(""))
    body = F.regexp_replace("part", r"(?s)^\d+\n\n```\n.*?\n```\n\n", "")
    return parts.select("doc_id", F.regexp_extract("part", r"^(\d+)", 1).cast("int").alias("section_index"), field("section_title").alias("section_title"), field("page_range").alias("page_range"), field("element_type").alias("element_type"), body.alias("text"))


SIDECAR = "local_path string, company string, ticker string, title string, form string"


def report_sidecars(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Sidecar rows whose report's name is among reports (name), with fallbacks for company and title."""
    rows = rows.withColumn("name", F.element_at(F.split("local_path", "/"), -1)).join(reports.select("name").distinct(), "name", "left_semi")
    return rows.select("local_path", F.coalesce(filled(F.col("company")), filled(F.col("ticker")), F.lit("unknown")).alias("company"), F.coalesce(filled(F.col("title")), F.col("name")).alias("title"), "form")


def read_report_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """*.meta.json files below root whose report is there."""
    rows = spark.read.schema(SIDECAR).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(root, multiLine=True)
    return report_sidecars(rows, read_corpus(spark, root).select(F.col("file_name").alias("name")))


def write_ingestion_report(rollup: DataFrame, items: DataFrame, path: str) -> None:
    """One JSON file a run: the roll-up's rows. Rows a document go beside it, as they grow with the collection."""
    rollup.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    items.write.mode("overwrite").json(f"{path}/documents")


#: Lengths below and above which chunks and sections count as short and long.
CHUNK_BOUNDS, SECTION_BOUNDS, ROLES = (50, 1500), (800, 4000), ["root", "parent", "leaf"]


def _observed(name: str, text_col: str, bounds: tuple[int, int] | None = None, role: str | None = None) -> list[Column]:
    """Length figures of all rows, or of one role's, as aggregates that are made while rows pass by."""
    size = F.length(strip(F.coalesce(text_col, F.lit(""))))
    size = size if role is None else F.when(F.col("chunk_role") == role, size)
    out = {"count": F.count(size), "total": F.sum(size), "min": F.min(size), "max": F.max(size), "p": F.percentile_approx(size, [0.5, 0.9, 0.95], 10_000)}
    if bounds:
        out |= {"short": F.count_if(size < bounds[0]), "long": F.count_if(size > bounds[1])}
    return [v.alias(f"{name}_{k}") for k, v in out.items()]


def _figures(found: dict, name: str, bounds: tuple[int, int] | None = None) -> dict:
    get = lambda k: found.get(f"{name}_{k}")
    count, (p50, p90, p95) = get("count") or 0, get("p") or (0, 0, 0)
    out = {"count": count, "avg_length": round((get("total") or 0) / count, 2) if count else 0.0, "p50_length": p50, "p90_length": p90, "p95_length": p95, "min_length": get("min") or 0, "max_length": get("max") or 0}
    return out if bounds is None else {"short_threshold": bounds[0], "long_threshold": bounds[1], "short_count": get("short") or 0, "long_count": get("long") or 0, **out}


def write_run(chunks: DataFrame, sections: DataFrame, items: DataFrame, path: str, run: dict | None = None) -> dict:
    """Writes a run's chunks (chunk_id, doc_id, chunk_role, text ...) and sections (doc_id, text ...) below path, and its
    report, which is returned: one nested JSON file of the run's fields, the roll-up of its items, and the lengths of
    chunks, sections and chunks by role.

    The figures are observed metrics: they are counted while chunks and sections are written, so no text is read again
    and nothing but them reaches the driver. Percentiles are approximate, by a ten-thousandth of the rows. Figures a
    document and a file type, whose number grows with the collection, are files of rows beside the report, made from
    the written files' narrow columns; so are the items. A report counts once its file is there: it is written last."""
    spark = chunks.sparkSession
    seen = {"chunks": Observation(), "sections": Observation()}
    by_role = [c for role in ROLES for c in _observed(role, "text", None, role)]
    chunks.observe(seen["chunks"], *_observed("chunk", "text", CHUNK_BOUNDS), *by_role).write.mode("overwrite").parquet(f"{path}/chunks")
    sections.observe(seen["sections"], *_observed("section", "text", SECTION_BOUNDS)).write.mode("overwrite").parquet(f"{path}/sections")
    stored, cut = (spark.read.schema(df.schema).parquet(f"{path}/{name}") for df, name in ((chunks, "chunks"), (sections, "sections")))
    per_doc = stored.groupBy("doc_id").agg(F.count("*").alias("chunks"), *(F.count_if(F.col("chunk_role") == r).alias(r) for r in ROLES))
    per_doc.join(cut.groupBy("doc_id").agg(F.count("*").alias("sections")), "doc_id", "full").na.fill(0).write.mode("overwrite").json(f"{path}/documents")
    items.write.mode("overwrite").json(f"{path}/items")
    rollup = [r.asDict() for r in ingestion_rollup(items).collect()]  # a row a file type and a failed stage
    found = seen["chunks"].get | seen["sections"].get
    report = {
        **(run or {}),
        "rollup": rollup,
        "chunk_stats": _figures(found, "chunk", CHUNK_BOUNDS),
        "section_stats": _figures(found, "section", SECTION_BOUNDS),
        "hierarchy_stats": {role: _figures(found, role) for role in ROLES},
    }
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report


def read_run_report(spark: SparkSession, path: str) -> DataFrame:
    """(part, count, avg_length, min_length, max_length, short_count, long_count): the lengths of a run's report."""
    one = "struct<count:long,avg_length:double,min_length:long,max_length:long,short_count:long,long_count:long>"
    rows = spark.read.schema(f"chunk_stats {one}, section_stats {one}, hierarchy_stats struct<{','.join(f'{r}:{one}' for r in ROLES)}>").json(f"{path}/report")
    parts = [("chunk", F.col("chunk_stats")), ("section", F.col("section_stats")), *((r, F.col("hierarchy_stats")[r]) for r in ROLES)]
    return rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("part"), c.alias("s")) for n, c in parts))).alias("x")).select("x.part", "x.s.*")

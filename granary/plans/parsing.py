"""Queries of parsing, sections, chunks and retries: results that SQL can't express, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from granary.functions.queries import rewrite
from granary.functions.tables import written
from granary.operators import blocks as B
from granary.operators import bm25, fusion, sections
from granary.plans.ingest import blocks as line_blocks
from granary.plans.registry import query
from granary.plans.retrieval import BM25_TOP, SCORED, store_of
from granary.sources import files, parsing


@query("html_blocks")
def html_blocks(t):
    return parsing.html_blocks(t.pages)


@query("html_to_markdown")
def html_to_markdown(t):
    return parsing.html_to_markdown(t.pages)


MARKED = "select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 7 = 0 then '# ' else '' end || x || case when (i - 1) % 5 = 4 then chr(10) else '' end), chr(10)) as body from documents"


@query(
    "text_blocks",
    rf"""with m as ({MARKED}), l as (select doc_id, regexp_replace(unnest(string_split(body, chr(10))), '^\s+|\s+$', '', 'g') as line, unnest(range(0, len(string_split(body, chr(10))))) as pos from m),
h as (select *, line <> '' and (starts_with(line, '#') or (length(line) <= 80 and regexp_matches(line, '^\d+(\.\d+)*[、.．\s]+'))) as heading from l),
e as (select *, line = '' or heading as ends from h),
b as (select *, ends or coalesce(lag(ends) over (partition by doc_id order by pos), true) as begins from e),
i as (select *, sum(case when begins then 1 else 0 end) over (partition by doc_id order by pos) as island from b),
g as (select doc_id, min(pos) as first_at, bool_or(heading) as title, string_agg(line, chr(10) order by pos) as joined from i where line <> '' group by doc_id, island),
x as (select doc_id, first_at, title, case when title then regexp_replace(regexp_replace(joined, '^#+', ''), '^\s+|\s+$', '', 'g') else joined end as text from g)
select doc_id, row_number() over (partition by doc_id order by first_at) - 1 as block_index, case when title then 'title' else 'text' end as block_type, text from x where text <> ''""".replace("\\\\", "\\"),
)
def text_blocks(t):
    """Documents with a heading mark on every seventh line and a blank line after every fifth."""
    line = lambda x, i: F.concat(F.when(i % 7 == 0, "# ").otherwise(""), x, F.when(i % 5 == 4, "\n").otherwise(""))
    return B.text_blocks(t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text")))


def prepared(t):
    rows = line_blocks(t).withColumns({"html": F.lit(None).cast("string"), "extra": F.lit(None).cast("map<string,string>")})
    return B.block_section_text(rows)


@query("build_sections")
def build_sections(t):
    return sections.build_sections(prepared(t))


@query("sections_to_markdown")
def sections_to_markdown(t):
    return files.sections_to_markdown(build_sections(t))


@query("read_section_audit")
def read_section_audit(t):
    return files.read_section_audit(sections_to_markdown(t))


@query("blocks_to_markdown")
def blocks_to_markdown(t):
    return B.blocks_to_markdown(line_blocks(t))


@query("hierarchical_chunks")
def hierarchical_chunks(t):
    """By tokens of a public tokenizer."""
    return sections.hierarchical_chunks(t.documents, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def table_blocks(t):
    """Each document's words as tables of three columns, one a page, under one header."""
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-zÀ-ÿ]+)"), F.lit(1))
    found = t.documents.select("doc_id", "source", words.alias("words"))
    steps = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 30).cast("int"))
    rows = found.select("doc_id", "source", F.posexplode(F.transform(steps, lambda i: F.slice("words", (i * 30 + 1).cast("int"), 30))).alias("block_index", "w"))
    body = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("| "), F.array_join(F.slice("w", (k * 3 + 1).cast("int"), 3), " | "), F.lit(" |")))
    text = F.concat(F.lit("| a | b | c |\n| --- | --- | --- |\n"), F.array_join(body, "\n"))
    return rows.select("doc_id", "block_index", F.lit("table").alias("block_type"), text.alias("text"), (F.col("block_index") + 1).cast("long").alias("page_no"), F.col("source").alias("source_path"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("map<string,string>").alias("extra"))


@query("merge_cross_page_tables")
def merge_cross_page_tables(t):
    return B.merge_cross_page_tables(table_blocks(t)).withColumn("extra", F.to_json("extra"))


@query("split_large_tables")
def split_large_tables(t):
    return sections.split_large_tables(B.merge_cross_page_tables(table_blocks(t)))


@query(
    "retry_bad_queries",
    rf"""with {SCORED}, ranked as (select query_id, chunk_id, score, {BM25_TOP} as rank from scored where score > 0),
first as (select query_id, max(score) < 100 or sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) < 100 as bad from ranked join documents on doc_id = chunk_id where rank <= 5 group by 1)
select query_id, rank, chunk_id, round(score, 6) as score from ranked join first using (query_id) where rank <= case when bad then 10 else 5 end""".replace("\\\\", "\\"),
)
def retry_bad_queries(t):
    """Lexical search; queries judged bad by a high threshold run again, rewritten and with ten hits, and replace."""
    store = store_of(t)
    asked = t.benchmark.selectExpr("item_id as query_id", "text")
    text = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_path"), "text")
    run = lambda q, k: written(bm25.top_k(store.score(q, k=k), k, F.desc(F.round("score", 9))), "retry-run").join(text, "chunk_id").withColumn("auto_merged", F.lit(False))
    first = run(asked, 5)
    bad = fusion.retrieval_quality(asked, first, min_top1=100.0).where("quality = 'bad'").select("query_id")
    again = run(asked.join(bad, "query_id").select("query_id", rewrite(F.col("text"))["rewritten"].alias("text")), 10)
    return first.join(bad, "query_id", "left_anti").unionByName(again).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))

"""Queries of collection sync, block cleaning and statistics over documents cut to lines and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.tables import work_dir, written
from granary.operators import blocks as B
from granary.operators import rollups as R
from granary.operators import sync as S
from granary.plans.registry import INPUTS, query
from granary.sources.chunk_store import ChunkStore

INPUTS["state_old"] = "select source || '/' || cast(doc_id as string) || '.txt' as source_path, doc_id, case when doc_id % 9 = 0 then cast(null as string) else md5(text) end as sha256, cast(1 as bigint) as updated_at from documents where doc_id % 7 <> 1"
INPUTS["state_now"] = "select source || '/' || cast(doc_id as string) || '.txt' as source_path, doc_id, md5(case when doc_id % 5 = 2 then text || '!' else text end) as sha256, n_chars as file_size from documents where doc_id % 8 <> 3"

DIFF = "diff as (select source_path, case when o.source_path is null then 'added' when n.source_path is null then 'deleted' when o.sha256 is not distinct from n.sha256 then 'unchanged' else 'updated' end as action, coalesce(n.doc_id, o.doc_id) as doc_id, o.sha256 as old_sha256, n.sha256 as new_sha256, o.updated_at as before from state_old o full join state_now n using (source_path))"


@query("diff_documents", f"with {DIFF} select source_path, action, doc_id, old_sha256, new_sha256 from diff")
def diff_documents(t):
    return S.diff_documents(t.state_old, t.state_now)


@query("next_state", f"with {DIFF} select source_path, doc_id, new_sha256 as sha256, case when action = 'unchanged' then coalesce(before, 9) else 9 end as updated_at, 9 as last_seen_at from diff where action <> 'deleted'")
def next_state(t):
    return S.next_state(t.state_old, t.state_now, 9).drop("file_size")


INPUTS["library"] = "select source_path, case when doc_id % 6 = 0 then 'deleted' else 'active' end as status, 'indexed' as index_status, cast(doc_id as bigint) as file_size, case when doc_id % 2 = 0 then '.txt' else '.md' end as file_type from state_old"
INPUTS["in_index"] = "select source_path from state_now where doc_id % 4 = 0"


@query(
    "sync_library",
    """with j as (select source_path, l.status, l.index_status, l.file_size as old_size, n.file_size, n.source_path is not null as seen, i.source_path is not null as ind from library l full join state_now n using (source_path) left join in_index i using (source_path))
select 'doc_' || substr(sha1(source_path), 1, 32) as library_id, source_path, case when seen then 'active' when status = 'active' then 'deleted' else status end as status,
  case when seen then case when ind then 'indexed' else 'pending' end when status = 'active' then 'pending' else index_status end as index_status, coalesce(file_size, old_size) as file_size from j""",
)
def sync_library(t):
    return S.sync_library(t.library, t.state_now, t.in_index)


@query("library_overview", "select count(*) as documents, count(case when index_status = 'indexed' then 1 end) as indexed, count(case when index_status <> 'indexed' then 1 end) as pending, sum(file_size) as bytes, (select string_agg(x, ',' order by x) from (select distinct file_type as x from library)) as types from library")
def library_overview(t):
    return R.library_overview(t.library)


@query(
    "apply_document_diff",
    f"""with {DIFF} select 'old' || cast(doc_id as string) as chunk_id, doc_id from state_old where doc_id not in (select doc_id from diff where action in ('deleted', 'updated'))
union all select 'new' || cast(doc_id as string), doc_id from state_now where doc_id in (select doc_id from diff where action in ('added', 'updated'))""",
)
def apply_document_diff(t):
    store = t.state_old.select(F.concat(F.lit("old"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id")
    fresh = t.state_now.select(F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id")
    return S.apply_document_diff(store, S.diff_documents(t.state_old, t.state_now), fresh).select("chunk_id", "doc_id")


@query(
    "upsert_chunk_store",
    r"""with base as (select 'k' || cast(doc_id as string) as chunk_id, source as doc_id, text from documents),
batch as (select 'k' || cast(floor(doc_id / 3) * 2 as bigint) as chunk_id, source as doc_id, case when doc_id % 10 = 0 then ' ' else 'v' || cast(doc_id as string) end as text, doc_id as seq from documents),
b as (select chunk_id, doc_id, text from (select *, row_number() over (partition by chunk_id order by seq desc) as back from batch where regexp_replace(text, '\s', '', 'g') <> '') where back = 1)
select chunk_id, doc_id, md5(text) as text_md5 from base where chunk_id not in (select chunk_id from b) union all select chunk_id, doc_id, md5(text) from b""",
)
def upsert_chunk_store(t):
    base = t.documents.selectExpr("'k' || cast(doc_id as string) as chunk_id", "source as doc_id", "text")
    batch = t.documents.selectExpr("'k' || cast(cast(floor(doc_id / 3) * 2 as bigint) as string) as chunk_id", "source as doc_id", "case when doc_id % 10 = 0 then ' ' else 'v' || cast(doc_id as string) end as text", "doc_id as seq")
    return S.upsert_chunk_store(base, batch, "seq").select("chunk_id", "doc_id", F.md5("text").alias("text_md5"))


@query(
    "chunk_store_sink",
    r"""with base as (select 'k' || cast(doc_id as string) as chunk_id, source as doc_id, text from documents),
batch as (select 'k' || cast(floor(doc_id / 3) * 2 as bigint) as chunk_id, source as doc_id, case when doc_id % 10 = 0 then ' ' else 'v' || cast(doc_id as string) end as text, doc_id as seq from documents),
b as (select chunk_id, doc_id, text from (select *, row_number() over (partition by chunk_id order by seq desc) as back from batch where regexp_replace(text, '\s', '', 'g') <> '') where back = 1)
select chunk_id, doc_id, md5(text) as text_md5 from base where chunk_id not in (select chunk_id from b) and regexp_replace(text, '\s', '', 'g') <> '' union all select chunk_id, doc_id, md5(text) from b""",
)
def chunk_store_sink(t):
    """The same rows through the store in a folder, as two batches."""
    store = ChunkStore(t.spark, work_dir(t.spark, "chunk-store"), "chunk_id string, doc_id string, text string", 16)
    store.upsert(t.documents.selectExpr("'k' || cast(doc_id as string) as chunk_id", "source as doc_id", "text", "doc_id as seq"), "seq")
    store.upsert(t.documents.selectExpr("'k' || cast(cast(floor(doc_id / 3) * 2 as bigint) as string) as chunk_id", "source as doc_id", "case when doc_id % 10 = 0 then ' ' else 'v' || cast(doc_id as string) end as text", "doc_id as seq"), "seq")
    return store.rows().select("chunk_id", "doc_id", F.md5("text").alias("text_md5"))


@query("file_fingerprint", "select doc_id, sha256(text) as sha256 from documents")
def file_fingerprint(t):
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query("derive_doc_id", r"select doc_id, case when doc_id % 3 = 0 then 'named_' || cast(doc_id as string) else 'my_' || lower(source) || '_' || cast(doc_id as string) || '_txt' end as derived from documents")
def derive_doc_id(t):
    """Every third document has a front matter that names it."""
    n = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('---\ntitle: x\ndoc_id: "named_'), n, F.lit('"\n---\n'), F.col("text"))).otherwise(F.col("text"))
    path = F.concat(F.lit("My "), F.col("source"), F.lit("/"), n, F.lit(".txt"))
    return t.documents.select("doc_id", T.derive_doc_id(path, text).alias("derived"))


#: A document's lines as blocks: in Spark by posexplode, in DuckDB by unnest.
LINES = "lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as pos from documents)"
KIND = "case when pos % 7 = 0 then 'title' when pos % 7 = 3 then 'list_item' else 'text' end"
BLOCKS = f"""{LINES}, blocks as (select doc_id, pos as block_index, {KIND} as block_type, case when pos % 7 = 0 then substr(line, 1, cast(1 + (pos * 5 + doc_id) % 45 as int)) when pos % 11 = 5 then 'page ' || cast(pos as string) when pos % 13 = 4 then 'Home' when pos % 5 = 1 then 'Header of ' || cast(doc_id as string) || chr(10) || line else line end as text,
  cast(floor(pos / 5) as bigint) + 1 as page_no, case when doc_id % 4 = 0 then '.pdf' when doc_id % 4 = 1 then '.docx' when doc_id % 4 = 2 then '.html' else '.txt' end as file_type from lines)"""


def blocks(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.selectExpr("doc_id", "pos as block_index", f"{KIND} as block_type", "case when pos % 7 = 0 then substr(line, 1, cast(1 + (pos * 5 + doc_id) % 45 as int)) when pos % 11 = 5 then 'page ' || cast(pos as string) when pos % 13 = 4 then 'Home' when pos % 5 = 1 then 'Header of ' || cast(doc_id as string) || chr(10) || line else line end as text", "cast(floor(pos / 5) as bigint) + 1 as page_no", "case when doc_id % 4 = 0 then '.pdf' when doc_id % 4 = 1 then '.docx' when doc_id % 4 = 2 then '.html' else '.txt' end as file_type")


NORM = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')".replace("{{", "{").replace("}}", "}")


@query(
    "filter_noise_blocks",
    f"""with {BLOCKS}, n as (select * replace ({NORM} as text) from blocks)
select doc_id, block_index, md5(text) as text_md5 from n where text <> '' and not case file_type when '.pdf' then regexp_matches(text, '(?i)^(\\d{{1,4}}|[-–—]\\s*\\d{{1,4}}\\s*[-–—]|\\d{{1,4}}\\s*/\\s*\\d{{1,4}}|(page|p\\.)\\s*\\d{{1,4}})$')
  when '.docx' then lower(text) in ('contents', 'table of contents') or (length(text) <= 120 and regexp_matches(text, '\\.{{3,}}\\s*\\d{{1,4}}$')) when '.html' then length(text) <= 30 and lower(text) in ('home', 'menu', 'login', 'logout', 'register', 'search', 'back to top', 'more') else false end""",
)
def filter_noise_blocks(t):
    return B.filter_noise_blocks(blocks(t)).select("doc_id", "block_index", F.md5("text").alias("text_md5"))


@query(
    "remove_repeated_lines",
    f"""with {BLOCKS}, p as (select doc_id, count(distinct page_no) as pages from blocks group by 1),
f as (select doc_id, block_index, unnest(string_split(text, chr(10))) as raw, unnest(range(0, len(string_split(text, chr(10))))) as k from blocks where text <> ''), s as (select *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from f),
r as (select doc_id, line from s join p using (doc_id) where line <> '' and length(line) <= 40 and pages >= 3 group by doc_id, line, pages having count(*) / pages >= 0.6),
t as (select distinct doc_id from r),
k as (select doc_id, block_index, regexp_replace(string_agg(raw, chr(10) order by k), '^\\s+|\\s+$', '', 'g') as text from s where line <> '' and (doc_id, line) not in (select (doc_id, line) from r) group by 1, 2)
select doc_id, block_index, md5(text) as text_md5 from blocks where text = '' or doc_id not in (select doc_id from t) union all select doc_id, block_index, md5(text) from k where doc_id in (select doc_id from t)""",
)
def remove_repeated_lines(t):
    return B.remove_repeated_lines(blocks(t)).select("doc_id", "block_index", F.md5("text").alias("text_md5"))


@query(
    "merge_title_fragments",
    f"""with {BLOCKS}, small as (select doc_id, block_index, case when block_index % 4 < 2 then 'title' else 'text' end as block_type, case when block_index % 4 = 0 then substr(text, 1, 2) else text end as text from blocks),
n as (select doc_id, block_index, block_type, {NORM} as text from small),
x as (select *, block_type = 'title' and length(text) between 1 and 2 as frag from n),
i as (select *, coalesce(sum(case when frag then 0 else 1 end) over (partition by doc_id order by block_index rows between unbounded preceding and 1 preceding), 0) as island from x),
g as (select *, string_agg(case when frag then text end, '' order by block_index) over w as carry, last_value(frag) over w as open_end, last_value(block_type) over w as last_type, lead(frag) over (partition by doc_id, island order by block_index) as tail from i
  window w as (partition by doc_id, island order by block_index rows between unbounded preceding and unbounded following)),
o as (select *, frag and not coalesce(tail, false) and (open_end or last_type <> 'title') as demoted from g),
e as (select doc_id, block_index, demoted, block_type, case when demoted then carry when not frag and block_type = 'title' and carry is not null then carry || text else text end as text from o where not frag or demoted)
select doc_id, block_index, case when demoted or (block_type = 'title' and length(text) >= 40) then 'text' else block_type end as block_type, md5(text) as text_md5 from e""",
)
def merge_title_fragments(t):
    small = blocks(t).selectExpr("doc_id", "block_index", "case when block_index % 4 < 2 then 'title' else 'text' end as block_type", "case when block_index % 4 = 0 then substr(text, 1, 2) else text end as text")
    return B.merge_title_fragments(small).select("doc_id", "block_index", "block_type", F.md5("text").alias("text_md5"))


@query(
    "fix_titles",
    f"""with {BLOCKS}, small as (select doc_id, block_index, page_no, case when block_index % 6 < 4 then 'title' else 'text' end as block_type, case when block_index % 3 = 0 then substr(text, 1, 2) else substr(text, 1, 30) end as text from blocks),
b as (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from small),
l as (select *, lag(t) over w as pt, lag(block_type) over w as pb, lag(page_no) over w as pp from b window w as (partition by doc_id order by block_index)),
i as (select *, sum(case when block_type = 'title' and pb = 'title' and pp = page_no and t <> '' and pt <> '' and (length(pt) <= 2 or length(t) <= 2) then 0 else 1 end) over (partition by doc_id order by block_index) as island from l),
g as (select doc_id, min(block_index) as block_index, min_by(block_type, block_index) as bt, string_agg(t, '' order by block_index) as joined, min_by(text, block_index) as first_text from i group by doc_id, island)
select doc_id, block_index, case when bt = 'title' and (length(joined) >= 40 or contains(joined, ',')) then 'text' else bt end as block_type, md5(case when bt = 'title' then joined else first_text end) as text_md5 from g""",
)
def fix_titles(t):
    small = blocks(t).selectExpr("doc_id", "block_index", "page_no", "case when block_index % 6 < 4 then 'title' else 'text' end as block_type", "case when block_index % 3 = 0 then substr(text, 1, 2) else substr(text, 1, 30) end as text", "cast(null as struct<x:double,y:double,w:double,h:double>) as bbox")
    return B.fix_titles(small).select("doc_id", "block_index", "block_type", F.md5("text").alias("text_md5"))


PAGED = f"{LINES}, pages_of as (select doc_id, cast(floor(pos / 3) as bigint) + 1 as page_no, case when cast(floor(pos / 3) as bigint) % 4 = 3 then ' ' else string_agg(line, chr(10) order by pos) end as text from lines group by doc_id, cast(floor(pos / 3) as bigint))"


def paged(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("page_no", F.floor(F.col("pos") / 3) + 1)
    rows = rows.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return rows.withColumn("text", F.when((F.col("page_no") - 1) % 4 == 3, " ").otherwise(F.col("text")))


SIZE = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


@query("pdf_text_probe", f"with {PAGED} select doc_id, sum({SIZE}) as probe_chars, sum({SIZE}) < 100 as is_scanned from pages_of where page_no <= 3 group by 1")
def pdf_text_probe(t):
    return B.pdf_text_probe(paged(t))


QUALITY_BLOCKS = [
    "doc_id",
    "block_index",
    "case when block_index % 7 = 3 then 'table' when block_index % 17 = 9 then 'image' else block_type end as block_type",
    "case when block_index % 7 = 3 and doc_id % 4 = 0 then ' ' else text end as text",
    "case when doc_id % 6 = 0 and block_index % 3 > 0 then null else page_no end as page_no",
]


@query(
    "block_quality",
    f"""with {BLOCKS}, {PAGED.removeprefix(LINES + ", ")}, b as (select {", ".join(QUALITY_BLOCKS)} from blocks where doc_id % 10 <> 7),
follows as (select doc_id, page_no = lag(page_no) over (partition by doc_id order by block_index) + 1 as next from b where block_type = 'table'),
near as (select doc_id, count(case when next then 1 end) as table_candidates from follows group by 1),
probe as (select doc_id, sum({SIZE}) < 100 as is_scanned from pages_of where page_no <= 3 group by 1),
sums as (select doc_id, count(*) as blocks, count(case when block_type = 'title' then 1 end) as titles, count(case when block_type = 'text' then 1 end) as texts, count(case when block_type = 'list_item' then 1 end) as list_items,
  count(case when block_type = 'table' then 1 end) as tables, count(case when block_type = 'image' then 1 end) as images, count(distinct page_no) as pages, min(page_no) as low, max(page_no) as high, count(*) - count(page_no) as missing_pages,
  sum({SIZE}) as chars, count(case when {SIZE} > 0 then 1 end) as with_text from b group by 1),
q as (select doc_id, coalesce(blocks, 0) as blocks, coalesce(titles, 0) as titles, coalesce(texts, 0) as texts, coalesce(list_items, 0) as list_items, coalesce(tables, 0) as tables, coalesce(images, 0) as images, coalesce(pages, 0) as pages,
  case when low is null then '' when low = high then cast(low as string) else cast(low as string) || '-' || cast(high as string) end as page_range, coalesce(missing_pages, 0) as missing_pages, coalesce(table_candidates, 0) as table_candidates,
  case when with_text > 0 then round(chars / with_text, 2) else 0 end as mean_chars, coalesce(chars, 0) as chars, coalesce(with_text, 0) as with_text, coalesce(is_scanned, false) as scan
  from documents left join sums using (doc_id) left join near using (doc_id) left join probe using (doc_id)),
f as (select *, concat_ws(',', case when scan then 'scanned_pdf_requires_ocr' end, case when tables > 0 then 'table_blocks_present' end, case when table_candidates > 0 then 'cross_page_table_candidate' end, case when images > 0 then 'image_blocks_present' end,
  case when blocks > 0 and missing_pages * 2 >= blocks then 'missing_page_metadata' end, case when blocks = 0 then 'empty_parse_result' end, case when with_text > 0 and chars < 200 then 'very_sparse_text' end) as flags from q)
select doc_id, blocks, titles, texts, list_items, tables, images, pages, page_range, missing_pages, table_candidates, mean_chars, flags, case when blocks = 0 or scan then 'poor' when flags <> '' then 'needs_review' else 'ok' end as level from f""",
)
def block_quality(t):
    """Blocks with tables, images and missing pages; one document in ten gave no block."""
    return B.block_quality(blocks(t).where("doc_id % 10 <> 7").selectExpr(*QUALITY_BLOCKS), B.pdf_text_probe(paged(t)), t.documents)


@query("page_summary", f"with {PAGED} select doc_id, count(*) as pages, sum({SIZE}) as chars, count(case when {SIZE} = 0 then 1 end) as empty_pages from pages_of group by 1")
def page_summary(t):
    return B.page_summary(paged(t))


@query("pages_to_markdown", rf"with {PAGED}, s as (select doc_id, page_no, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from pages_of) select doc_id, md5(string_agg('## Page ' || cast(page_no as string) || chr(10) || chr(10) || text, chr(10) || chr(10) order by page_no)) as markdown_md5 from s where text <> '' group by 1")
def pages_to_markdown(t):
    return B.pages_to_markdown(paged(t)).select("doc_id", F.md5("markdown").alias("markdown_md5"))


@query("block_section_text", rf"with {BLOCKS} select doc_id, block_index, md5(case block_type when 'title' then '## ' when 'list_item' then '- ' else '' end || regexp_replace(text, '^\s+|\s+$', '', 'g')) as text_md5 from blocks")
def block_section_text(t):
    rows = blocks(t).withColumns({"html": F.lit(None).cast("string"), "extra": F.lit(None).cast("map<string,string>")})
    return B.block_section_text(rows).select("doc_id", "block_index", F.md5("section_text").alias("text_md5"))


STATS = "count(*) as count, round(avg(n), 2) as mean, {ps}, min(n) as min, max(n) as max, count(case when n < 50 then 1 end) as short, count(case when n > 1500 then 1 end) as long"


@query(
    "length_stats",
    f"""with l as (select lang, {SIZE} as n from documents), r as (select *, row_number() over (partition by lang order by n) - 1 as rank, count(*) over (partition by lang) as total from l)
select lang, {STATS.format(ps=", ".join(f"max(case when rank = round_even((total - 1) * {p}, 0) then n end) as p{int(p * 100)}" for p in (0.5, 0.9, 0.95)))} from r group by 1""",
)
def length_stats(t):
    return R.length_stats(t.documents, "lang")


BY = ["source", "lang"]
BY_SQL = f"""l as (select source, lang, {SIZE} as n from documents), d as (select 'all' as dimension, '' as value, n from l union all select 'source', source, n from l union all select 'lang', lang, n from l),
r as (select *, row_number() over (partition by dimension, value order by n) - 1 as rank, count(*) over (partition by dimension, value) as total from d)"""
STATS_BY = "dimension, value, " + STATS.format(ps=", ".join(f"max(case when rank = round_even((total - 1) * {p}, 0) then n end) as p{int(p * 100)}" for p in (0.5, 0.9, 0.95)))


@query("length_stats_by", f"with {BY_SQL} select {STATS_BY} from r group by 1, 2")
def length_stats_by(t):
    return R.length_stats_by(t.documents, BY)


@query("length_sketches", f"with {BY_SQL}, s as (select {STATS_BY} from r group by 1, 2) select dimension, value, count, mean, min, max, short, long, true as p50_near, true as p90_near, true as p95_near from s")
def length_sketches(t):
    """Two batches' sketches merged, beside the exact figures: whether each percentile's rank is within the error."""
    stored = written(reduce(DataFrame.unionByName, (R.length_sketches(t.documents.where(f"doc_id % 2 = {i}"), BY) for i in range(2))), "length-sketches")
    merged = R.merged_sketches(stored)
    found = R.sketched_stats(merged)
    counted = R.length_histogram(t.documents, BY).join(found.select("dimension", "value", "count", *(F.col(f"p{p}").alias(f"q{p}") for p in (50, 90, 95))), ["dimension", "value"])
    share = lambda p, c: F.sum(F.when(c(F.col("len"), F.col(f"q{p}")), F.col("n")).otherwise(0)) / F.first("count")
    near = lambda p: ((share(p, lambda x, q: x < q) <= p / 100 + R.RANK_ERROR) & (share(p, lambda x, q: x <= q) >= p / 100 - R.RANK_ERROR)).alias(f"p{p}_near")
    return found.drop("p50", "p90", "p95").join(counted.groupBy("dimension", "value").agg(*(near(p) for p in (50, 90, 95))), ["dimension", "value"])


INPUTS["run_items"] = "select case when doc_id % 3 = 0 then '.txt' when doc_id % 3 = 1 then '.pdf' end as file_type, case when doc_id % 10 = 0 then 'failed' else 'success' end as status, case when doc_id % 20 = 0 then 'parse' else 'chunk' end as stage, doc_id % 50 as block_count, case when doc_id % 10 <> 0 then doc_id % 20 end as chunk_count from documents"
SUMS = "count(*) as documents, count(case when status = 'success' then 1 end) as succeeded, count(case when status = 'failed' then 1 end) as failed, sum(coalesce(block_count, 0)) as blocks, sum(coalesce(chunk_count, 0)) as chunks, case when count(case when status = 'success' then 1 end) > 0 then round(sum(coalesce(block_count, 0)) / count(case when status = 'success' then 1 end), 2) else 0 end as mean_blocks, case when count(case when status = 'success' then 1 end) > 0 then round(sum(coalesce(chunk_count, 0)) / count(case when status = 'success' then 1 end), 2) else 0 end as mean_chunks"


@query("ingestion_rollup", f"select 'all' as scope, '' as value, {SUMS} from run_items union all select 'file_type', coalesce(file_type, 'unknown'), {SUMS} from run_items group by 2 union all select 'failed_stage', stage, {SUMS} from run_items where status = 'failed' group by 2")
def ingestion_rollup(t):
    return R.ingestion_rollup(t.run_items)


@query("chunk_index", "select chunk_id, doc_id, row_number() over (partition by doc_id order by case chunk_role when 'parent' then 1 else 2 end, chunk_index, chunk_id) - 1 as place from chunks")
def chunk_index(t):
    rows = t.chunks.withColumnRenamed("chunk_index", "ordinal")
    return R.chunk_index(rows, F.when(F.col("chunk_role") == "parent", 1).otherwise(2), F.col("ordinal")).select("chunk_id", "doc_id", F.col("chunk_index").alias("place"))


@query(
    "merge_sections_per_doc",
    rf"""with {PAGED}, s as (select doc_id, page_no, 'Part ' || cast(page_no as string) as title, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from pages_of)
select doc_id, md5(string_agg('## ' || title || chr(10) || text, chr(10) || chr(10) order by page_no)) as text_md5, count(*) as section_count, string_agg(case when page_no <= 20 then cast(page_no as string) end, ',' order by page_no) as page_ranges from s group by 1""",
)
def merge_sections_per_doc(t):
    rows = paged(t).select("doc_id", F.col("page_no").alias("section_index"), F.concat(F.lit("Part "), F.col("page_no").cast("string")).alias("section_title"), "text", F.col("page_no").cast("string").alias("page_range"))
    return R.merge_sections(rows).select("doc_id", F.md5("text").alias("text_md5"), "section_count", "page_ranges")


#: A user's events of a day are the post-processors of one call.
INPUTS["traced"] = """select user_id, cast(ts as date) as day, case when event_type = 'click' then 'LLMRerank' when event_type = 'view' then 'AutoMergingRetriever' when event_type = 'error' then '' else event_type || ' Post-Processor!' end as name,
  case when event_type = 'error' then cast(null as double) else value end as duration_ms, event_type, value, event_id from events"""
INPUTS["calls"] = """select user_id, day, case when count(*) % 5 = 0 then cast(null as double) else max(value) end as core, case when count(*) % 3 = 0 then cast(0 as double) when count(*) % 3 = 1 then cast(null as double) else max(value) * 2 end as whole,
  count(*) % 4 = 0 as fallback, case when count(*) % 7 = 0 then cast(null as boolean) else count(*) % 2 = 0 end as enabled, count(*) % 6 = 0 as hit from traced group by user_id, day"""
KEYED = "case when name = '' then '' when contains(lower(name), 'rerank') then 'rerank_ms' when contains(lower(name), 'automerging') then 'auto_merge_ms' else regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_ms' end"


def profiles(t):
    steps = t.traced.groupBy("user_id", "day").agg(F.collect_list(F.struct(F.when(F.col("name") == "", "").otherwise(R.timing_key(F.col("name"))).alias("timing_key"), "duration_ms")).alias("postprocessors"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    rows = t.calls.join(steps, ["user_id", "day"])
    return rows.select(F.col("core").alias("retriever_core_ms"), F.col("whole").alias("retrieval_total_profiled_ms"), "postprocessors", "fallback", F.struct("enabled", "hit").alias("cache"), F.when(F.col("fallback"), F.col("kinds")).alias("fallback_reasons"))


@query(
    "trace_rollup",
    f"""select * from (select 'retriever_core_ms' as timing_key, round(sum(coalesce(core, 0)), 3) as total_ms, count(*) as steps from calls union all select 'retrieval_profiled_ms', round(sum(coalesce(nullif(whole, 0), core, 0)), 3), count(*) from calls
union all select {KEYED} as k, round(sum(coalesce(duration_ms, 0)), 3), count(*) from traced where name <> '' group by 1) where total_ms > 0""",
)
def trace_rollup(t):
    return R.trace_rollup(profiles(t))


@query("trace_counts", "select count(*) as calls, count(case when fallback then 1 end) as fallbacks, bool_or(coalesce(enabled, false)) as cache_enabled, count(case when hit then 1 end) as cache_hits, count(case when enabled and not hit then 1 end) as cache_misses from calls")
def trace_counts(t):
    return R.trace_counts(profiles(t))


@query("fallback_reasons", "select event_type as reason, count(*) as calls from (select distinct user_id, day, event_type from traced) join calls using (user_id, day) where fallback group by 1")
def fallback_reasons(t):
    return R.fallback_reasons(profiles(t))


JOBS = "select event_id as job_id, ts as created_at, case event_id % 4 when 0 then 'failed' when 1 then 'running' when 2 then 'pending' else 'done' end as status from events"


@query("recent_jobs", f"with latest as (select * from ({JOBS}) order by created_at desc, job_id desc limit 8) select count(*) as recent_total, count(case when status in ('pending', 'running') then 1 end) as running, count(case when status = 'failed' then 1 end) as failed from latest")
def recent_jobs(t):
    """Events as jobs; the overview shows the eight latest."""
    return R.recent_jobs(t.sql(JOBS))

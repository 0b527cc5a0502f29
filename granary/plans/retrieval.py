"""Queries over hits and chunks that are derived from documents, and search of benchmark texts in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.tables import numbered, work_dir
from granary.operators import bm25, dense, fusion, search
from granary.operators.bm25_store import Bm25Store
from granary.plans.registry import INPUTS, query

INPUTS["chunks"] = """
select 'c' || cast(doc_id as string) as chunk_id, 'd' || cast(cast(floor(doc_id / 30) as bigint) as string) as doc_id, source || '/' || cast(doc_id as string) || '.txt' as source_path,
  case when doc_id % 10 = 8 then cast(null as string) when doc_id % 10 = 9 then 'x' || cast(doc_id as string) else 'p' || cast(cast(floor(doc_id / 3) as bigint) as string) end as parent_id,
  'leaf' as chunk_role, doc_id as chunk_index, cast(1 + doc_id % 9 as string) || '-' || cast(3 + doc_id % 9 as string) as page_range, text as text,
  case when doc_id % 11 = 0 then 't' || cast(doc_id % 3 as string) else '' end as table_id
from documents
union all
select 'p' || cast(g as string), doc_id, doc_id || '/parent.txt', 'r0', 'parent', cast(0 as bigint), '1', case when g % 7 = 0 then ' ' else 'Parent ' || cast(g as string) || ': ' || body end, ''
from (select cast(floor(doc_id / 3) as bigint) as g, 'd' || cast(min(cast(floor(doc_id / 30) as bigint)) as string) as doc_id, min(text) as body from documents group by cast(floor(doc_id / 3) as bigint)) grouped
"""

INPUTS["hits"] = """
select query_id, row_number() over (partition by query_id order by score desc, chunk_index) as rank, chunk_id, doc_id, source_path, parent_id, chunk_role, chunk_index, page_range, text, table_id, score
from (select 'q' || cast(cast(floor(chunk_index / 40) as bigint) * 2 + cast(floor(chunk_index / 2) as bigint) % 2 as string) as query_id, *, cast((chunk_index * 37) % 100 as double) / 100 as score
      from chunks where chunk_role = 'leaf') scored
"""

INPUTS["asks"] = "select distinct query_id from hits"

STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TOKENS = r"regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.:/+\-]*')"

POSTINGS = f"""
tokens as (select doc_id as chunk_id, unnest({TOKENS}) as token from documents),
postings as (select token, chunk_id, count(*) as tf from tokens group by all),
lengths as (select chunk_id, sum(tf) as token_len from postings group by 1),
freq as (select token, count(*) as df from postings group by 1),
totals as (select count(*) as n, sum(token_len) as sum_len from lengths)
"""
SCORED = f"""
{POSTINGS},
qt as (select query_id, token, count(*) as qtf from (select item_id as query_id, unnest({TOKENS}) as token from benchmark) group by all),
scored as (
  select query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * token_len / (sum_len / n)))) as score
  from qt join postings using (token) join freq using (token) join lengths using (chunk_id), totals group by all)
"""


#: Path of a corpus's index by session and folder: built by the first query of a session that needs it, opened by others.
STORES: dict[tuple[str, str], str] = {}


def store_of(t):
    """The stored index of the documents."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in STORES:
        path = work_dir(t.spark, "bm25-index")
        Bm25Store(t.spark, path, 32).apply(t.documents, id_col="doc_id")
        STORES[key] = path
    return Bm25Store(t.spark, STORES[key], 32)


def scores_of(t, k=None):
    return store_of(t).score(t.benchmark, "item_id", k=k)


@query("bm25_tokens", rf"select doc_id, array_to_string({TOKENS}, ' ') as tokens, len({TOKENS}) as n from documents")
def bm25_tokens(t):
    tokens = T.bm25_tokens(F.col("text"))
    return t.documents.select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n"))


@query("bm25_index", f"with {POSTINGS} select token, row_number() over (order by token) - 1 as token_id, df, total_tf from freq join (select token, sum(tf) as total_tf from postings group by 1) using (token)")
def bm25_index(t):
    return numbered(store_of(t).frequencies(), "token", "token_id").select("token", "token_id", "df", F.col("tf").alias("total_tf"))


@query("bm25_score", f"with {SCORED} select query_id, chunk_id, round(score, 6) as score from scored where score > 0")
def bm25_score(t):
    return scores_of(t).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


BM25_TOP = "row_number() over (partition by query_id order by round(score, 9) desc, chunk_id)"


@query("bm25_topk", f"with {SCORED} select * from (select query_id, chunk_id, round(score, 6) as score, {BM25_TOP} as rank from scored where score > 0) where rank <= 20")
def bm25_topk(t):
    return bm25.top_k(scores_of(t, 20), 20, F.desc(F.round("score", 9))).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(
    "bm25_apply_delta",
    f"""with {POSTINGS.replace("from documents", "from (select doc_id, case when doc_id % 5 = 0 then text || ' fresh token' else text end as text from documents)")}
select token, df, n, sum_len from freq, totals""",
)
def bm25_apply_delta(t):
    """A corpus of which every fifth document is replaced by a longer version: its counts and the change's."""
    counts = lambda docs: bm25.counts(docs, "doc_id")
    changed = t.documents.where("doc_id % 5 = 0")
    longer = changed.withColumn("text", F.concat("text", F.lit(" fresh token")))
    frequencies, totals = bm25.apply_counts(*counts(t.documents), counts(changed), counts(longer))
    return frequencies.crossJoin(F.broadcast(totals))


COSINE = "list_inner_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_inner_product(a.embedding::double[], a.embedding::double[]) * list_inner_product(b.embedding::double[], b.embedding::double[]))"
DENSE = f"""dense as (select * from (select a.vec_id as query_id, b.vec_id as chunk_id, {COSINE} as score, row_number() over (partition by a.vec_id order by round({COSINE}, 9) desc, b.vec_id) as rank
  from (select * from embeddings where vec_id % 50 = 0) a, embeddings b) where rank <= 20)"""


def dense_hits(t, k=20):
    """Queries are all vectors whose id is divisible by 50."""
    return dense.dense_topk(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, k, "vec_id", "vec_id")


@query("dense_topk", f"with {DENSE} select query_id, chunk_id, round(score, 6) as score, rank from dense")
def dense_topk(t):
    return dense_hits(t).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


#: Queries with a text and a vector: every vector whose id is divisible by 50 and every benchmark text, whichever are
#: fewer used again.
INPUTS["searches"] = """
select case when e.place >= b.item_id then e.place else b.item_id end as query_id, text, embedding
from (select cast(floor(vec_id / 50) as bigint) as place, embedding, (select case when v.n < i.n then v.n else i.n end from (select count(*) as n from embeddings where vec_id % 50 = 0) v, (select count(*) as n from benchmark) i) as m from embeddings where vec_id % 50 = 0) e
join (select item_id, text, (select case when v.n < i.n then v.n else i.n end from (select count(*) as n from embeddings where vec_id % 50 = 0) v, (select count(*) as n from benchmark) i) as m from benchmark) b on e.place % e.m = b.item_id % b.m
"""
SEARCHED = f"""{SCORED.replace("item_id as query_id", "query_id").replace("from benchmark)", "from searches)")},
lexical as (select query_id, chunk_id, score, {BM25_TOP} as rank from scored where score > 0 qualify rank <= 20),
near as (select query_id, b.vec_id as chunk_id, {COSINE} as score, row_number() over (partition by query_id order by round({COSINE}, 9) desc, b.vec_id) as rank from searches a, embeddings b qualify rank <= 20),
both_lists as (select query_id, chunk_id, rank from lexical union all select query_id, chunk_id, rank from near),
fused as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 12) desc, chunk_id) as rank
  from (select query_id, chunk_id, sum(1 / (60.0 + rank)) as score from both_lists group by all)) where rank <= 20)"""


@query("rrf_fuse", f"with {SEARCHED} select query_id, chunk_id, round(score, 9) as score, rank from fused where rank <= 10")
def rrf_fuse(t):
    return search.candidate_lists(t.searches, store_of(t).score(t.searches, k=20), vectors_of(t))["hybrid"].where("rank <= 10").select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def vectors_of(t):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("child_counts", "select parent_id, count(*) as children from chunks where chunk_role = 'leaf' and parent_id is not null group by 1")
def child_counts(t):
    return fusion.child_counts(t.chunks)


@query("select_leaf_chunks", "select chunk_id, doc_id, chunk_index from chunks where chunk_role = 'leaf'")
def select_leaf_chunks(t):
    return fusion.select_leaf_chunks(t.chunks).select("chunk_id", "doc_id", "chunk_index")


@query(
    "expand_parent_context",
    f"""with j as (select h.*, p.text as ptext, p.doc_id as pdoc, case when h.parent_id is null then 'missing_parent_id' when p.chunk_id is null then 'not_found' else 'found' end as lookup_status
  from hits h left join chunks p on h.parent_id = p.chunk_id),
f as (select *, row_number() over (partition by query_id, case when lookup_status = 'found' then parent_id else '#' || cast(rank as string) end order by rank) as first from j)
select query_id, rank, case when lookup_status = 'found' then parent_id else chunk_id end as chunk_id,
  md5(case when lookup_status = 'found' then regexp_replace(substr({STRIPPED.format("ptext")}, 1, 2000), '\\s+$', '') else text end) as text_md5,
  case when lookup_status = 'found' then chunk_id end as child_chunk_id, case when lookup_status = 'found' then md5(substr(text, 1, 200)) end as preview_md5, lookup_status
from f where first = 1""",
)
def expand_parent_context(t):
    rows = fusion.expand_parent_context(t.hits, t.chunks, 2000)
    return rows.select("query_id", "rank", "chunk_id", F.md5("text").alias("text_md5"), "child_chunk_id", F.md5("child_preview").alias("preview_md5"), "lookup_status")


MERGED = f"""counts as (select parent_id, count(*) as children from chunks where chunk_role = 'leaf' and parent_id is not null group by 1),
groups as (select query_id, parent_id, count(distinct chunk_id) as found, max(score) as best, string_agg(chunk_id, ',' order by rank) as members, min(rank) as first from hits where parent_id is not null group by 1, 2),
chosen as (select g.*, children, {STRIPPED.format("coalesce(p.text, '')")} as ptext from groups g join counts using (parent_id) left join chunks p on p.chunk_id = g.parent_id where found / children >= 0.5),
out_rows as (
select query_id, first as rank, 0 as sub, parent_id as chunk_id, regexp_replace(substr(ptext, 1, 4000), '\\s+$', '') as text, best as score, true as auto_merged, round(found / children, 4) as merge_ratio, members from chosen where ptext <> ''
union all select query_id, rank, 0, chunk_id, text, score, false, null, null from hits h where not exists (select 1 from chosen c where c.query_id = h.query_id and c.parent_id = h.parent_id)
union all select h.query_id, first, h.rank, chunk_id, text, score, false, null, null from hits h join chosen c on c.query_id = h.query_id and c.parent_id = h.parent_id where ptext = ''),
merged as (select query_id, row_number() over (partition by query_id order by rank, sub, chunk_id) as rank, chunk_id, text, score, auto_merged, merge_ratio, members from out_rows)"""


@query("auto_merge", f"with {MERGED} select query_id, rank, chunk_id, md5(text) as text_md5, score, auto_merged, merge_ratio, coalesce(members, '') as members from merged")
def auto_merge(t):
    rows = fusion.auto_merge(t.hits, t.chunks)
    return rows.select("query_id", "rank", "chunk_id", F.md5("text").alias("text_md5"), "score", "auto_merged", "merge_ratio", F.coalesce(F.array_join("child_chunk_ids", ","), F.lit("")).alias("members"))


TABLED = f"""known as (select doc_id, table_id as t, chunk_index, chunk_id, page_range, {STRIPPED.format("text")} as body from chunks where table_id <> '' and chunk_role <> 'root'),
named as (select * from (select *, row_number() over (partition by query_id, table_id order by rank) as nth from hits where table_id <> '') where nth = 1),
counts_of as (select doc_id, t, count(*) as node_count, min_by(page_range, chunk_index) as first_range from known group by 1, 2),
texts_of as (select doc_id, t, string_agg(body, chr(10) || chr(10) order by first_at) as table_text from (select doc_id, t, body, min(chunk_index) as first_at from known where body <> '' group by 1, 2, 3) group by 1, 2),
tabled as (select n.query_id, n.rank, n.table_id || '::context' as chunk_id, md5(table_text) as text_md5, chunk_id as child_chunk_id, first_range as table_page_range, node_count
from named n join counts_of c on c.doc_id = n.doc_id and c.t = n.table_id join texts_of x on x.doc_id = n.doc_id and x.t = n.table_id
union all select query_id, rank, chunk_id, md5(text), null, null, null from hits where table_id = '')"""


@query("expand_table_context", f"with {TABLED} select * from tabled")
def expand_table_context(t):
    rows = fusion.expand_table_context(t.hits, t.chunks)
    return rows.select("query_id", "rank", "chunk_id", F.md5("text").alias("text_md5"), "child_chunk_id", "table_page_range", "node_count")


LISTED = "select 'bm25' as strategy, query_id, rank, chunk_id, score from lexical union all select 'dense', query_id, rank, chunk_id, score from near union all select 'hybrid', query_id, rank, chunk_id, score from fused"


NAMED = SEARCHED.replace("select doc_id as chunk_id, unnest", "select 'c' || cast(doc_id as string) as chunk_id, unnest").replace("b.vec_id", "('c' || cast(b.vec_id as string))")


@query(
    "hybrid_search",
    f"""with {NAMED}, cands as (select strategy || ':' || cast(l.query_id as string) as query_id, rank, score, c.* from ({LISTED}) l join chunks c on c.chunk_id = l.chunk_id),
{MERGED.replace("from hits", "from cands")}, placed as (select m.*, c.doc_id, c.table_id from merged m join chunks c using (chunk_id)),
{TABLED.replace("from hits", "from placed")}
select split_part(query_id, ':', 1) as strategy, split_part(query_id, ':', 2) as query_id, row_number() over (partition by tabled.query_id order by rank) as place, chunk_id, text_md5 from tabled qualify place <= 10""",
)
def hybrid_search(t):
    """Every query by bm25, by vectors and by both, with parents and tables for context; documents are the chunks."""
    chunk = lambda df: df.withColumn("chunk_id", F.concat(F.lit("c"), F.col("chunk_id").cast("string")))
    scored = store_of(t).score(t.searches, chunk_name=F.concat(F.lit("c"), F.col("chunk_id").cast("string")), k=20)
    got = search.hybrid_search(t.searches, scored, chunk(vectors_of(t)), t.chunks)
    return got.select("strategy", "query_id", F.col("rank").alias("place"), "chunk_id", F.md5("text").alias("text_md5"))


@query(
    "rerank_topn",
    """with c as (select *, count(*) over (partition by query_id) >= 6 as reranked, cast((chunk_index * 53) % 97 as double) as rerank_score from hits),
r as (select query_id, chunk_id, reranked, row_number() over (partition by query_id order by case when reranked then rerank_score end desc nulls last, rank, chunk_id) as rank from c)
select * from r where not reranked or rank <= 3""",
)
def rerank_topn(t):
    scored = t.hits.withColumn("rerank_score", F.expr("cast((chunk_index * 53) % 97 as double)"))
    return fusion.rerank_topn(scored).select("query_id", "chunk_id", "reranked", "rank")


PACKED = f"""b as (select query_id, chunk_id, rank, score, {STRIPPED.format("text")} as text from hits),
d as (select *, row_number() over (partition by query_id, regexp_replace(text, '\\s+', ' ', 'g') order by score desc, rank, chunk_id) as nth from b where text <> ''),
u as (select *, coalesce(sum(length(text)) over (partition by query_id order by score desc, rank, chunk_id rows between unbounded preceding and 1 preceding), 0) as used,
  row_number() over (partition by query_id order by score desc, rank, chunk_id) as snippet_no from d where nth = 1)"""


@query("pack_context", f"with {PACKED} select query_id, snippet_no, chunk_id, md5(substr(text, 1, cast(4000 - used as bigint))) as text_md5 from u where used < 4000")
def pack_context(t):
    return fusion.pack_context(t.hits).select("query_id", "snippet_no", "chunk_id", F.md5("text").alias("text_md5"))


@query(
    "pack_evidence",
    f"""with b as (select query_id, rank, source_path, {STRIPPED.format("text")} as text from hits),
u as (select *, coalesce(sum(length(text)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as used from b where text <> '')
select query_id, rank, md5('[' || cast(rank as string) || '] ' || split_part(source_path, '/', 2) || chr(10) || substr(text, 1, cast(9000 - used as bigint))) as block_md5 from u where used < 9000""",
)
def pack_evidence(t):
    return fusion.pack_evidence(t.hits).select("query_id", "rank", F.md5("block").alias("block_md5"))


@query(
    "citations",
    """select * from (select query_id, row_number() over (partition by query_id order by score desc, rank, chunk_id) as source_no, doc_id, split_part(source_path, '/', 2) as file_name, source_path, chunk_id, parent_id, score from hits)
where source_no <= 5""",
)
def citations(t):
    return fusion.citations(t.hits)


QUALITY = f"""q as (select query_id, min_by(score, rank) as top1_score, count(*) as node_count, sum(length({STRIPPED.format("text")})) as total_text_length, count(distinct source_path) as source_count, bool_or(auto_merged) as auto_merged from quality_hits group by 1)"""
INPUTS["quality_hits"] = "select *, rank % 4 = 0 as auto_merged from hits where score < 0.25 or chunk_index % 3 > 0"
REASON = "case when node_count is null then 'empty' when top1_score < 0.3 then 'low_top1' when total_text_length < 100 then 'short_text' when source_count > 5 then 'good_scattered' else 'good' end"


@query(
    "retrieval_quality",
    f"""with {QUALITY} select query_id, top1_score, coalesce(node_count, 0) as node_count, coalesce(total_text_length, 0) as total_text_length, coalesce(source_count, 0) as source_count, coalesce(auto_merged, false) as auto_merged,
{REASON} as reason, case when {REASON} like 'good%' then 'good' else 'bad' end as quality, {REASON} not like 'good%' as should_retry, case when {REASON} like 'good%' then 5 else 10 end as suggested_top_k
from asks left join q using (query_id)""",
)
def retrieval_quality(t):
    return fusion.retrieval_quality(t.asks, t.quality_hits)


@query(
    "multi_query_union",
    """with s as (select query_id as question_id, cast(chunk_index % 3 as bigint) as sub_index, rank, case when chunk_index % 4 = 0 then '' else chunk_id end as chunk_id, doc_id, source_path from hits),
k as (select *, row_number() over (partition by question_id, coalesce(nullif(chunk_id, ''), doc_id) order by sub_index, rank) as nth from s)
select question_id, row_number() over (partition by question_id order by sub_index, rank, chunk_id) as rank, sub_index, chunk_id, doc_id from k where nth = 1""",
)
def multi_query_union(t):
    rows = t.hits.selectExpr("query_id as question_id", "cast(chunk_index % 3 as bigint) as sub_index", "rank", "case when chunk_index % 4 = 0 then '' else chunk_id end as chunk_id", "doc_id", "source_path")
    return fusion.multi_query_union(rows).select("question_id", "rank", "sub_index", "chunk_id", "doc_id")


@query("table_markers", "select chunk_id, table_id, page_range as table_page_range from chunks")
def table_markers(t):
    """Every other chunk carries its table in the text's markers instead of the columns."""
    marked = F.col("chunk_index") % 2 == 0
    text = F.when(marked, F.concat(F.lit("[Table_ID: "), F.coalesce(F.nullif("table_id", F.lit("")), F.lit(" ")), F.lit("]\n[TABLE_PAGE_RANGE: "), F.col("page_range"), F.lit("]\n"), F.col("text"))).otherwise(F.col("text"))
    own = lambda c: F.when(~marked, F.col(c))
    return t.chunks.select("chunk_id", fusion.table_id(text, own("table_id")).alias("table_id"), fusion.table_pages(text, own("page_range")).alias("table_page_range"))

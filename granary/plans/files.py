"""Queries of file sources, sinks and streams: Spark writes the tables' rows as files first, then the operator reads them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import rollups as R
from granary.operators.memory import RECENT, TRIGGER
from granary.plans.ingest import SUMS
from granary.plans.registry import query
from granary.sources import files, parsing
from granary.streaming import jobs, stateful


@query("read_corpus", "select '.txt' as file_type, source, count(*) as docs from documents group by 2")
def read_corpus(t):
    """Documents as text files of their source's folder, a line each."""
    path = files.work_dir(t.spark, "corpus")
    t.documents.select("source", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("source").text(path)
    found = files.read_corpus(t.spark, path)
    lines = F.size(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n"))
    return found.groupBy("file_type", F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(F.sum(lines).alias("docs"))


@query("read_questions", "select cast(item_id as string) as id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as question_md5, 1 + item_id % 2 as n_files, item_id % 3 as n_pages from benchmark where item_id % 5 <> 4".replace("\\\\", "\\"))
def read_questions(t):
    """Benchmark texts as questions; every fifth names no file and is dropped."""
    path = files.work_dir(t.spark, "questions")
    n = F.col("item_id")
    listed = F.when(n % 5 == 4, F.array()).when(n % 2 == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit("f"), F.lit("g")))
    pages = F.when(n % 3 == 0, F.array().cast("array<int>")).when(n % 3 == 1, F.array(F.lit(7))).otherwise(F.array(F.lit(7), F.lit(8)))
    t.benchmark.select(n.cast("string").alias("id"), F.col("text").alias("question"), listed.cast("array<string>").alias("gold_files"), pages.alias("gold_pages")).write.json(path)
    return files.read_questions(t.spark, path).select("id", F.md5("question").alias("question_md5"), F.size("gold_files").alias("n_files"), F.size("gold_pages").alias("n_pages"))


@query(
    "read_report_sidecars",
    "select 'reports/' || cast(doc_id as string) || '.pdf' as local_path, case when doc_id % 3 = 0 then 'ACME ' || source when doc_id % 3 = 1 then 'T' || cast(doc_id as string) else 'unknown' end as company, case when doc_id % 2 = 0 then 'Report ' || cast(doc_id as string) else cast(doc_id as string) || '.pdf' end as title, source as form from documents where doc_id % 5 <> 4",
)
def read_report_sidecars(t):
    """A sidecar for every document, in JSON lines; every fifth names a report that is not there."""
    path = files.work_dir(t.spark, "sidecars")
    n, text = F.col("doc_id"), F.col("doc_id").cast("string")
    row = [F.concat(F.lit("reports/"), text, F.lit(".pdf")).alias("local_path"), F.when(n % 3 == 0, F.concat(F.lit("ACME "), "source")).otherwise(" ").alias("company"), F.when(n % 3 == 1, F.concat(F.lit("T"), text)).alias("ticker"), F.when(n % 2 == 0, F.concat(F.lit("Report "), text)).alias("title"), F.col("source").alias("form")]
    t.documents.select(*row).write.json(path)
    reports = t.documents.where("doc_id % 5 <> 4").select(F.concat(text, F.lit(".pdf")).alias("name"))
    rows = t.spark.read.schema(files.SIDECAR).json(path)
    return files.report_sidecars(rows, reports)


@query("read_qrels", "select query_id, evidence_id, string_agg(distinct node_id, ',' order by node_id) as nodes from qrels group by 1, 2")
def read_qrels(t):
    path = files.work_dir(t.spark, "qrels")
    t.qrels.withColumn("relevance", F.lit("1.0")).write.csv(path, sep="\t", header=True)
    return files.read_qrels(t.spark, path).select("query_id", "evidence_id", F.array_join("node_ids", ",").alias("nodes"))


@query("write_ingestion_report", f"select 'all' as scope, '' as value, {SUMS} from run_items union all select 'file_type', coalesce(file_type, 'unknown'), {SUMS} from run_items group by 2 union all select 'failed_stage', stage, {SUMS} from run_items where status = 'failed' group by 2")
def write_ingestion_report(t):
    path, rollup = files.work_dir(t.spark, "report"), R.ingestion_rollup(t.run_items)
    files.write_ingestion_report(rollup, t.run_items, path)
    return t.spark.read.schema(rollup.schema).json(f"{path}/summary")


LENGTHS = "count(*) as count, coalesce(round(avg(n), 2), 0) as avg_length, coalesce(min(n), 0) as min_length, coalesce(max(n), 0) as max_length"


@query(
    "ingestion_run_report",
    rf"""with c as (select chunk_role, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as n from chunks), d as (select length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as n from documents)
select 'chunk' as part, {LENGTHS}, count(case when n < 50 then 1 end) as short_count, count(case when n > 1500 then 1 end) as long_count from c
union all select 'section', {LENGTHS}, count(case when n < 800 then 1 end), count(case when n > 4000 then 1 end) from d
union all select r.role, {LENGTHS.replace("count(*)", "count(n)")}, null, null from (values ('root'), ('parent'), ('leaf')) r(role) left join c on c.chunk_role = r.role group by 1""",
)
def ingestion_run_report(t):
    """A run that writes the derived chunks, and whole documents as sections; its report read back."""
    path = files.work_dir(t.spark, "run")
    files.write_run(t.chunks, t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), t.run_items, path, {"run_id": "test", "status": "done"})
    return files.read_run_report(t.spark, path)


@query("docx_blocks")
def docx_blocks(t):
    """Every document as a DOCX file: its lines as paragraphs, the first as a heading."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parsing.slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                style = ["<w:pPr><w:pStyle w:val='Heading1'/></w:pPr>"]
                body = "".join(f"<w:p>{''.join(style) if i == 0 else ''}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for i, x in enumerate((text or "").split("\n")))
                with zipfile.ZipFile(data := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    made = t.documents.select("doc_id", "text").mapInArrow(packed, "doc_id long, content binary")
    return parsing.docx_blocks(made, "doc_id").select("doc_id", "block_index", "block_type", "text", "error")


def run_through(t, name, rows, write):
    """Writes rows as files, streams them through write(stream, work folder), waits, and gives the folder."""
    path = files.work_dir(t.spark, name)
    rows.write.parquet(f"{path}/in")
    write(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


REQUESTS = "select event_id as request_id, concat_ws('|', cast(user_id as string), event_type) as cache_key, ts from events"
SERVED_SQL = f"""with recursive asked as (select *, row_number() over (partition by cache_key order by ts, request_id) as k from ({REQUESTS})),
chain as (
  select cache_key, k, request_id, ts, request_id as source_request, ts as stored_at from asked where k = 1
  union all
  select a.cache_key, a.k, a.request_id, a.ts, case when a.ts >= c.stored_at + interval 6 hour then a.request_id else c.source_request end, case when a.ts >= c.stored_at + interval 6 hour then a.ts else c.stored_at end
  from chain c join asked a on a.cache_key = c.cache_key and a.k = c.k + 1)"""


@query("stream_query_dedupe", f"{SERVED_SQL} select request_id, cache_key, case when request_id = source_request then 'computed' else 'served' end as status, source_request, cast(epoch_us(stored_at) as bigint) as stored_us from chain")
def stream_query_dedupe(t):
    """Events as requests whose key is user and type; one availableNow run. Every request has a row."""
    rows = t.sql(REQUESTS).withColumn("ts", F.col("ts").cast("timestamp"))
    write = lambda s, path: stateful.stream_query_dedupe(s).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    path = run_through(t, "stream-dedupe", rows, write)
    out = t.spark.read.schema("request_id long, cache_key string, ts timestamp, status string, source_request long, stored_at timestamp").parquet(f"{path}/out")
    return out.select("request_id", "cache_key", "status", "source_request", F.unix_micros("stored_at").alias("stored_us"))


@query("stream_served_results", f"{SERVED_SQL} select c.request_id, status, source_request, order_id, total from (select *, case when request_id = source_request then 'computed' else 'served' end as status, cast(split_part(cache_key, '|', 1) as bigint) as user_id from chain) c left join (select o_custkey as user_id, o_orderkey as order_id, round(o_totalprice, 2) as total from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3) using (user_id)")
def stream_served_results(t):
    """The same requests, answered: a user's three largest orders, computed once in six hours for a key."""

    def largest(requests):
        asked = requests.withColumn("o_custkey", F.split_part("cache_key", F.lit("|"), F.lit(1)).cast("long"))
        found = t.orders.join(asked.select("o_custkey").distinct(), "o_custkey", "left_semi")
        place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
        top = found.withColumn("place", place).where("place <= 3").select("o_custkey", F.col("o_orderkey").alias("order_id"), F.round("o_totalprice", 2).alias("total"))
        return asked.join(top, "o_custkey").select("request_id", "order_id", "total")

    rows = t.sql(REQUESTS).withColumn("ts", F.col("ts").cast("timestamp"))
    served = lambda path: stateful.ServedResults(t.spark, f"{path}/served", largest)
    write = lambda s, path: stateful.stream_query_dedupe(s).writeStream.foreachBatch(served(path).take).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    return served(run_through(t, "stream-served", rows, write)).answers().select("request_id", "status", "source_request", "order_id", "total")


@query(
    "stream_session_memory",
    f"with b as (select *, row_number() over (partition by session_id order by message_id desc) as back from messages) select session_id, count(*) as message_count, count(case when back > {RECENT} then 1 end) as evicted_message_count, "
    f"case when count(*) > {TRIGGER} then max(case when back > {RECENT} then message_id end) end as covered_until_message_id, coalesce(string_agg(case when back > {RECENT} and n > {TRIGGER} then cast(message_id as string) end, ',' order by message_id), '') as compressed_ids, "
    f"string_agg(case when back <= {RECENT} then cast(message_id as string) end, ',' order by message_id) as recent_ids from (select *, count(*) over (partition by session_id) as n from b) group by 1",
)
def stream_session_memory(t):
    """Messages of all sessions, as one availableNow run; the last state of each and all ids that were compressed."""
    rows = t.messages.select("session_id", "message_id", F.timestamp_seconds(F.col("message_id") + 1_700_000_000).alias("ts"))
    write = lambda s, path: stateful.stream_session_memory(s).writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    out = t.spark.read.schema(f"{stateful.MEMORY}, batch int").parquet(f"{run_through(t, 'stream-memory', rows, write)}/out").where("action <> 'expire'")
    last = [F.max_by(c, "batch").alias(c) for c in ("message_count", "evicted_message_count", "covered_until_message_id", "recent_ids")]
    got = out.groupBy("session_id").agg(*last, F.array_sort(F.flatten(F.collect_list("new_message_ids"))).alias("compressed_ids"))
    return got.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("recent_ids", "compressed_ids")})


@query("stream_ingest", r"with l as (select distinct doc_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as line from documents), k as (select distinct doc_id, pos, unnest(regexp_extract_all(lower(line), '[a-z0-9][a-z0-9_.:/+\-]*')) as token from l) select token, count(*) as df from k group by 1")
def stream_ingest(t):
    """All documents through the ingesting stream; the document frequencies of their lines."""
    rows = t.documents.select(F.concat_ws("/", "source", "doc_id").alias("source_path"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    path = run_through(t, "stream-ingest", rows, lambda s, path: jobs.stream_ingest(s, jobs.IngestStore(t.spark, f"{path}/store"), f"{path}/checkpoint"))
    return jobs.IngestStore(t.spark, f"{path}/store").statistics()[0]

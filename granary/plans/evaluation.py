"""Queries of relevance judgements and retrieval metrics over benchmark texts, documents and derived hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.tables import written
from granary.operators import evaluation as E
from granary.plans.registry import INPUTS, query

#: Gold of the derived hits: of each query's documents those that a rule calls relevant.
INPUTS["golds"] = "select query_id, chunk_id as gold_id, parent_id from hits where chunk_index % 6 = 1"
INPUTS["qrels"] = "select query_id, gold_id as node_id, 'e' || cast(length(gold_id) % 2 as string) || gold_id as evidence_id from golds union all select query_id, parent_id, 'e1' || gold_id from golds where parent_id is not null"

GRAMS = r"case when len({0}) = 0 then cast([] as varchar[]) when len({0}) <= 3 then [array_to_string({0}, '')] else list_distinct([{0}[i] || {0}[i+1] || {0}[i+2] for i in range(1, len({0}) - 1)]) end"
FLAT = r"string_split(lower(regexp_replace({0}, '\s+', '', 'g')), '')"
OVERLAP = "case when least(len({0}), len({1})) > 0 then len(list_intersect({0}, {1})) / least(len({0}), len({1})) else 0.0 end"

QUESTIONS = """questions as (select query_id, min(source_path) as f1, max(source_path) as f2, count(*) as n, min_by(text, rank) as gold_evidence from hits where rank <= 3 group by 1)"""


def questions(t):
    """A question of each derived query: files of its first hits, with as many, more or no pages."""
    rows = t.hits.where("rank <= 3").groupBy("query_id").agg(F.min("source_path").alias("f1"), F.max("source_path").alias("f2"), F.min_by("text", "rank").alias("gold_evidence"))
    n = F.substring("query_id", 2, 9).cast("int")
    pages = F.when(n % 3 == 0, F.array(n % 9 + 1, n % 7 + 2)).when(n % 3 == 1, F.array(n % 5 + 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("query_id", F.array("f1", "f2").alias("gold_files"), pages.alias("gold_pages"), "gold_evidence")


ANCHORS = """nq as (select *, cast(substr(query_id, 2) as int) as n from (select query_id, min(source_path) as f1, max(source_path) as f2, min_by(text, rank) as gold_evidence from hits where rank <= 3 group by 1)),
anchors as (select query_id, 'a1' as anchor_id, f1 as gold_file, n % 9 + 1 as gold_page from nq where n % 3 = 0 union all select query_id, 'a2', f2, n % 7 + 2 from nq where n % 3 = 0
union all select query_id, 'a1_p' || cast(n % 5 + 1 as string), f1, n % 5 + 1 from nq where n % 3 = 1 union all select query_id, 'a2_p' || cast(n % 5 + 1 as string), f2, n % 5 + 1 from nq where n % 3 = 1
union all select query_id, 'a1', f1, null from nq where n % 3 = 2 union all select query_id, 'a2', f2, null from nq where n % 3 = 2)"""


@query("evidence_anchors", f"with {ANCHORS} select query_id, anchor_id, gold_file, cast(gold_page as int) as gold_page from anchors")
def evidence_anchors(t):
    return E.evidence_anchors(questions(t))


MATCHES = f"""{ANCHORS},
g as (select query_id, {GRAMS.format("x")} as gold_grams from (select query_id, {FLAT.format("gold_evidence")} as x from nq)),
h as (select query_id, rank, chunk_id, source_path, cast(split_part(page_range, '-', 1) as int) as p1, cast(split_part(page_range, '-', 2) as int) as p2, {GRAMS.format("x")} as grams from (select *, {FLAT.format("text")} as x from hits)),
o as (select h.*, {OVERLAP.format("gold_grams", "grams")} as overlap from h join g using (query_id)),
p as (select o.*, anchor_id, gold_page, source_path = gold_file or ends_with(source_path, '/' || gold_file) or ends_with(gold_file, '/' || source_path) as fh, coalesce(gold_page between p1 and p2, false) as ph from o join anchors a using (query_id)),
m as (select query_id, rank, chunk_id, overlap, count(distinct case when fh and (ph or gold_page is null or overlap >= 0.35) then anchor_id end) as n_anchors,
  coalesce(string_agg(case when fh and (ph or gold_page is null or overlap >= 0.35) then anchor_id end, ',' order by anchor_id), '') as ids, bool_or(fh) as af, bool_or(ph) as ap, bool_or(gold_page is not null) as hp from p group by all),
matches as (select query_id, rank, chunk_id, overlap, n_anchors > 0 or (not af and overlap >= 0.75) as matched,
  case when n_anchors > 0 and ap then 'file_page' when n_anchors > 0 and af and not hp then 'file_only' when n_anchors > 0 then 'file_text_overlap' when not af and overlap >= 0.75 then 'text_overlap' else '' end as match_type,
  case when n_anchors = 0 and not af and overlap >= 0.75 then 'text_overlap' else ids end as ids from m)"""


def matches(t):
    return E.match_hits_to_anchors(t.hits, questions(t))


@query("match_hits_to_anchors", f"with {MATCHES} select query_id, rank, chunk_id, matched, match_type, round(overlap, 6) as overlap, ids as anchor_ids from matches")
def match_hits_to_anchors(t):
    return matches(t).select("query_id", "rank", "chunk_id", "matched", "match_type", F.round("overlap", 6).alias("overlap"), F.array_join("anchor_ids", ",").alias("anchor_ids"))


def cuts(one):
    return ", ".join(one.format(k=k) for k in E.CUTS)


@query(
    "anchor_metrics_at_k",
    f"""with {MATCHES}, n_a as (select query_id, count(*) as anchors from anchors group by 1),
f as (select query_id, rank, unnest(string_split(ids, ',')) as a from matches where matched),
s as (select query_id, min(rank) as first_hit_rank, {cuts("count(distinct case when rank <= {k} then a end) as n_{k}, bool_or(rank <= {k} and a = 'text_overlap') as w_{k}")} from f group by 1),
r as (select query_id, first_hit_rank, {cuts("case when coalesce(w_{k}, false) then 1.0 else coalesce(n_{k}, 0) / anchors end as r_{k}")} from n_a left join s using (query_id))
select query_id, first_hit_rank, {cuts("case when coalesce(first_hit_rank <= {k}, false) then 1.0 else 0.0 end as hit_{k}, round(r_{k}, 6) as recall_{k}, case when r_{k} >= 1 then 1.0 else 0.0 end as all_{k}, case when coalesce(first_hit_rank <= {k}, false) then round(1 / first_hit_rank, 6) else 0.0 end as mrr_{k}")} from r""",
)
def anchor_metrics_at_k(t):
    counts = E.evidence_anchors(questions(t)).groupBy("query_id").agg(F.count("*").alias("anchors"))
    got = E.anchor_metrics_at_k(matches(t), counts)
    return got.select(*(F.round(c, 6).alias(c) if c.startswith(("recall", "mrr")) else c for c in got.columns))


@query("match_type_counts", f"with {MATCHES} select 'hybrid' as strategy, match_type, count(*) as hits from matches where matched group by 2")
def match_type_counts(t):
    return E.match_type_counts(matches(t).withColumn("strategy", F.lit("hybrid")))


@query(
    "match_hits_to_qrels",
    """with f as (select distinct h.query_id, h.rank, h.chunk_id, q.evidence_id from hits h join qrels q on h.query_id = q.query_id and (q.node_id = h.chunk_id or q.node_id = h.parent_id)),
a as (select query_id, rank, chunk_id, string_agg(evidence_id, ',' order by evidence_id) as ids from f group by 1, 2, 3)
select query_id, rank, chunk_id, ids is not null as matched, coalesce(ids, '') as evidence_ids from hits left join a using (query_id, rank, chunk_id)""",
)
def match_hits_to_qrels(t):
    return E.match_hits_to_qrels(t.hits, t.qrels).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


METRICS = f"""g as (select query_id, count(*) as n_gold from golds group by 1),
m as (select h.query_id, {cuts("count(distinct case when rank <= {k} then chunk_id end) as n_{k}, min(case when rank <= {k} then rank end) as f_{k}")} from hits h join golds on golds.query_id = h.query_id and gold_id = chunk_id group by 1),
metrics as (select query_id, n_gold, {cuts("case when coalesce(n_{k}, 0) > 0 then 1.0 else 0.0 end as hit_{k}, coalesce(n_{k}, 0) / n_gold as recall_{k}, coalesce(n_{k}, 0) / {k} as precision_{k}, coalesce(1.0 / f_{k}, 0) as mrr_{k}")} from g left join m using (query_id))"""


@query("metrics_at_k", f"with {METRICS} select query_id, n_gold, {cuts('hit_{k}, round(recall_{k}, 6) as recall_{k}, round(precision_{k}, 6) as precision_{k}, round(mrr_{k}, 6) as mrr_{k}')} from metrics")
def metrics_at_k(t):
    got = E.metrics_at_k(t.hits, t.golds)
    return got.select(*(F.round(c, 6).alias(c) if "_" in c and c[-1].isdigit() and not c.startswith("hit") else c for c in got.columns))


DETAILS = "details as (select *, n % 2 as sn, case when n % 3 = 0 then 'easy' when n % 3 = 1 then 'medium' else 'hard' end as difficulty, case when n % 4 = 0 then 'numeric' else 'text' end as question_type, case when n % 2 = 0 then 'dense' else 'hybrid' end as strategy, cast((n * 37) % 500 as double) / 4 as latency_ms, case when n % 13 = 0 then 'timeout' else '' end as error, case when mrr_10 > 0 then 1 / mrr_10 end as first_hit_rank from (select *, cast(substr(query_id, 2) as int) as n from metrics))"
MEANS = "count(*) as questions, count(case when error <> '' then 1 end) as errors, round(avg(latency_ms), 2) as mean_latency_ms, round(avg(recall_10), 4) as recall_10, round(avg(hit_5), 4) as hit_5, round(avg(first_hit_rank), 6) as mean_first_hit_rank"


@query(
    "eval_summary",
    f"""with {METRICS}, {DETAILS} select strategy, 'all' as slice, '' as slice_value, {MEANS} from details group by strategy
union all select strategy, 'difficulty', difficulty, {MEANS} from details group by strategy, difficulty union all select strategy, 'question_type', question_type, {MEANS} from details group by strategy, question_type""",
)
def eval_summary(t):
    n = F.substring("query_id", 2, 9).cast("int")
    rows = E.metrics_at_k(t.hits, t.golds).withColumns({
        "difficulty": F.when(n % 3 == 0, "easy").when(n % 3 == 1, "medium").otherwise("hard"),
        "question_type": F.when(n % 4 == 0, "numeric").otherwise("text"),
        "strategy": F.when(n % 2 == 0, "dense").otherwise("hybrid"),
        "latency_ms": ((n * 37) % 500).cast("double") / 4,
        "error": F.when(n % 13 == 0, "timeout").otherwise(""),
        "first_hit_rank": F.when(F.col("mrr_10") > 0, 1 / F.col("mrr_10")),
    })
    return E.eval_summary(rows, ["recall_10", "hit_5"]).withColumn("mean_first_hit_rank", F.round("mean_first_hit_rank", 6))


@query(
    "evidence_overlap",
    f"""with x as (select a.doc_id, {FLAT.format("a.text")} as s, {FLAT.format("b.text")} as u from documents a join documents b on b.doc_id = a.doc_id + 1),
g as (select doc_id, {GRAMS.format("s")} as gs, {GRAMS.format("u")} as gu from x) select doc_id, round({OVERLAP.format("gs", "gu")}, 6) as overlap from g""",
)
def evidence_overlap(t):
    """Every document beside the next one."""
    after = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return E.gram_overlaps(t.documents.join(after, "doc_id"), "doc_id", "text", "next_text").select("doc_id", F.round("overlap", 6).alias("overlap"))


EVIDENCE = "select item_id as query_id, 'e' || cast(item_id as string) as evidence_id, 'src' || cast(item_id % 20 as string) as path, text as evidence_text from benchmark"
NODES = "select 'c' || cast(doc_id as string) as node_id, 'p' || cast(doc_id % 7 as string) as parent_id, source as path, text from documents"
SELECTED = f"""ne as (select query_id, evidence_id, path, {GRAMS.format("x")} as eg from (select *, {FLAT.format("evidence_text")} as x from ({EVIDENCE}))),
nn as (select node_id, parent_id, path, {GRAMS.format("x")} as ng from (select *, {FLAT.format("text")} as x from ({NODES}))),
s as (select query_id, evidence_id, node_id, parent_id, len(list_intersect(eg, ng)) / least(len(eg), len(ng)) as score from ne join nn using (path) where len(ng) > 0),
r as (select *, row_number() over (partition by query_id, evidence_id order by score desc, node_id) as place from s where score > 0),
k as (select * from r where place = 1 or (place <= 3 and score >= 0.25))"""


def judged(t):
    evidence, nodes = t.sql(EVIDENCE), t.sql(NODES)
    return evidence, nodes, written(E.best_nodes(evidence, nodes), "qrels-best")


@query(
    "build_node_qrels",
    f"""with {SELECTED},
f as (select query_id, evidence_id, place, score, node_id from k union all select query_id, evidence_id, place, score, parent_id from k)
select query_id, evidence_id, node_id, case when min(place) = 1 then 2 else 1 end as relevance, case when min(place) = 1 then 'primary' else 'secondary' end as qrel_role, round(max(score), 6) as match_score from f group by 1, 2, 3""",
)
def build_node_qrels(t):
    evidence, nodes, best = judged(t)
    return E.build_node_qrels(evidence, nodes, best=best).withColumn("match_score", F.round("match_score", 6))


@query(
    "node_qrels_diagnostics",
    f"""with {SELECTED}, c as (select path, count(*) as n from nn group by 1), g as (select query_id, evidence_id, count(*) as selected, max(score) as best from k group by 1, 2)
select ne.query_id, ne.evidence_id, path, coalesce(n, 0) as candidate_count, coalesce(selected, 0) as selected_count, coalesce(round(best, 4), 0.0) as best_score, coalesce(best < 0.25, false) as used_fallback_best
from ne left join c using (path) left join g on g.query_id = ne.query_id and g.evidence_id = ne.evidence_id""",
)
def node_qrels_diagnostics(t):
    evidence, nodes, best = judged(t)
    return E.node_qrels_diagnostics(evidence, nodes, best=best)


AUDITED = [
    "case when doc_id % 3 = 0 then text || '（单位：元）' else text end as question",
    "cast(doc_id % 4 as int) as n_contexts",
    "case when doc_id % 9 = 0 then 'abstention' else 'answer' end as eval_type",
    "case doc_id % 5 when 0 then 'table_numeric' when 1 then 'hard_negative_table_numeric' when 2 then 'profile' when 3 then '' end as question_type",
    "case doc_id % 3 when 0 then 'easy' when 1 then 'hard' end as difficulty",
]
IN_AUDIT = f"with audited as (select {', '.join(AUDITED)} from documents)"


@query(
    "eval_set_audit",
    f"""{IN_AUDIT}, n as (select count(*) as c from audited group by question)
select count(*) as questions, count(case when n_contexts > 1 then 1 end) as multi_evidence, count(case when eval_type = 'abstention' then 1 end) as abstentions, count(case when n_contexts = 0 then 1 end) as missing_contexts,
  count(case when question_type in ('table_numeric', 'hard_negative_table_numeric') and not contains(question, '单位') then 1 end) as numeric_without_unit, (select count(*) from n) as distinct_questions, (select count(*) from n where c > 1) as duplicated from audited""",
)
def eval_set_audit(t):
    """Whole texts of documents as questions; copies count as repeated."""
    return E.eval_set_audit(t.documents.selectExpr(*AUDITED))


@query("eval_set_counts", f"{IN_AUDIT} select 'question_type' as slice, coalesce(nullif(question_type, ''), 'unknown') as value, count(*) as questions from audited group by 2 union all select 'difficulty', coalesce(difficulty, 'unknown'), count(*) from audited group by 2")
def eval_set_counts(t):
    return E.eval_set_counts(t.documents.selectExpr(*AUDITED))


ANSWERS = ["doc_id as answer_id", "case when doc_id % 7 = 0 then 'nan?' else cast(cast(doc_id % 100 as double) / 100 as string) end as faithfulness", "case when doc_id % 5 = 0 then '' else cast(cast(n_chars % 10 as double) / 10 as string) end as relevancy"]
ANSWERED = f"with answers as (select {', '.join(ANSWERS)} from documents)"


@query("answer_metric_summary", f"{ANSWERED} select 'faithfulness' as metric, round(avg(try_cast(faithfulness as double)), 4) as mean, count(try_cast(faithfulness as double)) as n from answers union all select 'relevancy', round(avg(try_cast(relevancy as double)), 4), count(try_cast(relevancy as double)) from answers")
def answer_metric_summary(t):
    return E.answer_metric_summary(t.documents.selectExpr(*ANSWERS), ["faithfulness", "relevancy"])


@query("lowest_answers", f"{ANSWERED} select answer_id, faithfulness from answers order by try_cast(faithfulness as double) nulls last, answer_id limit 5")
def lowest_answers(t):
    """The report shows the five lowest."""
    return E.lowest_answers(t.documents.selectExpr(*ANSWERS), "faithfulness", "answer_id", 5).select("answer_id", "faithfulness")


@query(
    "build_answer_eval_set",
    r"""with c as (select query_id, string_agg(md5(text), ',' order by rank) as contexts, count(*) as source_count from hits where regexp_replace(text, '\s', '', 'g') <> '' group by 1)
select query_id, coalesce(contexts, '') as contexts, coalesce(source_count, 0) as source_count, length(query_id) % 2 = 0 as usable from asks left join c using (query_id)""",
)
def build_answer_eval_set(t):
    asked = t.asks.selectExpr("query_id", "query_id as question", "'a' as answer", "case when length(query_id) % 2 = 0 then 'answer' else ' ' end as response")
    got = E.build_answer_eval_set(asked, t.hits)
    return got.select("query_id", F.array_join(F.transform("retrieved_contexts", F.md5), ",").alias("contexts"), "source_count", "usable")


CLAIMS = "claims as (select conv_id as answer_id, turn, case when (conv_id + turn) % 7 = 0 then 'contradicted' when (conv_id + turn) % 3 = 0 then 'Partial ' when (conv_id + turn) % 5 = 0 then 'maybe' else 'supported' end as verdict, 'claim ' || cast(turn as string) as claim from conversations)"


@query(
    "grounding_score",
    f"""with {CLAIMS}, v as (select answer_id, claim, turn, case when trim(lower(verdict)) in ('supported', 'partial', 'contradicted') then trim(lower(verdict)) else 'unsupported' end as verdict from claims),
s as (select answer_id, round(avg(case verdict when 'supported' then 1.0 when 'partial' then 0.5 else 0 end), 4) as grounding_score, bool_or(verdict = 'contradicted') as bad, coalesce(string_agg(case when verdict in ('unsupported', 'contradicted') then claim end, ',' order by claim), '') as unsupported from v group by 1)
select answer_id, grounding_score, case when bad then 'fail' when grounding_score >= 0.8 then 'pass' when grounding_score >= 0.5 then 'warning' else 'fail' end as verdict, unsupported from s""",
)
def grounding_score(t):
    rows = t.conversations.selectExpr("conv_id as answer_id", "turn", "case when (conv_id + turn) % 7 = 0 then 'contradicted' when (conv_id + turn) % 3 = 0 then 'Partial ' when (conv_id + turn) % 5 = 0 then 'maybe' else 'supported' end as verdict", "'claim ' || cast(turn as string) as claim")
    payloads = rows.groupBy("answer_id").agg(F.to_json(F.struct(F.collect_list(F.struct("claim", "verdict")).alias("claims"))).alias("payload"))
    return E.grounding_score(payloads).withColumn("unsupported", F.array_join("unsupported", ","))

"""Rules over query texts: routing, clarification, rewriting, decomposition."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import collapse, strip

#: Fixed word lists and patterns of the router.
GREETINGS = [r"(?i)^(你好|您好|hello|hi|hey)\s*[!！。,.，？?]*$", r"(?i)^(谢谢|感谢|thanks|thank you)\s*[!！。,.，？?]*$", r"(?i)^(再见|拜拜|bye|goodbye)\s*[!！。,.，？?]*$", r"^(你是谁|你能做什么|介绍一下你自己)\s*[!！。,.，？?]*$", r"^(在吗|还在吗|可以开始吗)\s*[!！。,.，？?]*$"]
SMALL_TALK = ["你好", "您好", "谢谢", "感谢", "再见", "拜拜", "你是谁", "你能做什么", "你可以做什么", "介绍一下你自己", "你好你能做什么", "你好你可以做什么"]
SMALL_TALK_PARTS = ["你能做什么", "你可以做什么", "你是谁", "介绍一下你自己"]
MEMORY_WRITE = r"(?i)(请记住|帮我记住|记一下|你记住|remember that)"
MEMORY_CHAT = [MEMORY_WRITE, r"(我刚刚|我刚才|我前面|刚才|前面).{0,12}(说了什么|说过什么|提到什么|聊了什么)", r"(总结一下|概括一下|回顾一下).{0,12}(前面|刚才|刚刚|我们刚才|我们前面)", r"(我们刚才|我们前面|刚刚).{0,12}(说到哪|聊到哪|讲到哪)", r"(我让你记住了什么|你还记得什么|你记得我说过什么)"]
STATISTICS = ["统计", "数量", "多少", "总数", "平均", "最大", "最小", "排行", "排名", "top", "count", "sum", "avg", "max", "min"]
ENTITIES = ["用户", "订单", "题目", "考试", "成绩", "分数", "上传", "文档数", "访问量", "日志", "表", "数据库"]
KNOWLEDGE = ["资料", "知识库", "手册", "规范", "制度", "方案", "报告", "章节", "条款", "说明", "如何", "怎么", "文档", "课件"]
NEWS = ["最新", "今天", "昨天", "最近", "新闻", "资讯", "实时", "当前", "现在", "发布", "行情", "官网"]
NEWS_IN_DOCUMENTS = ["文档中", "知识库", "这份文档", "上传的文档", "资料里", "报告里"]
STATISTICS_IN_DOCUMENTS = ["文档中", "文档里", "知识库", "资料里", "报告里"]
STEPS = ["对比", "比较", "分析", "总结", "归纳", "结合", "分别", "影响", "优缺点", "建议", "方案", "步骤", "流程"]
LEAST_STEPS_CHARS = 18
VAGUE = ["这个", "这两个", "那个", "它", "他们", "上面", "刚才"]
#: Fixed questions back to the asker, by reason.
ASK_BACK = {"missing_comparison_targets": "你想让我对比哪两个对象？请补充对象名称或对应文档范围。", "missing_candidates_and_criteria": "你想比较哪些候选项？评价标准是性能、成本、稳定性，还是其他维度？", "ambiguous_reference": "这里的“这个”具体指什么？请补充文档、问题对象或上下文范围。", "short_ambiguous_reference": "你这里指的是哪个对象或哪段内容？请补充一下上下文。"}
#: Fixed phrases of the rewriter, in the order they are replaced; words it drops.
FORMAL = {"怎么弄": "操作流程", "怎么搞": "操作方法", "搞一下": "操作步骤", "啥意思": "定义 含义", "咋回事": "原因 说明", "咋办": "解决方法 处理方式", "咋用": "使用方法 操作指南"}
FILLERS = ["这个", "那个", "这些", "那些", "一下"]
#: Fixed words of the decomposer.
COMPARISONS = ["比较", "对比", "共同点", "差异", "区别", "分别", "compare", "difference"]
SEPARATORS = [r"\bcompare\b", r"\bdifference between\b", r"\bversus\b", r"\bvs\.?\b", "对比", "比较", "区别", "差异", "分别", "以及", "和", "与", "、"]
#: Fixed patterns and templates of the decomposer, and phrases of the clarifier.
ENTITY = r"(\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*){0,4}\b)"
PART_ENDS = r"^[\s?？,，。]+|[\s?？,，。]+$"
ABOUT_ONE = " 在材料中体现出的核心变化过程、原因和关键表现是什么？"
ABOUT_BOTH = " 体现出的变化过程有哪些共同点和差异？"
WHAT_IS = "是什么？"
TWO_TARGETS = ["对比这两个", "比较这两个"]
WHICH_IS_BETTER, CANDIDATES = "哪个更好", "和|与|还是|对比|比较"
THIS_ONE = ["总结这个", "分析这个", "处理这个问题"]
NO_ENTITIES = ["RAG", "Agentic", "JSON", "LLM", "API"]


def has_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs, whatever its case: one pattern, as chains of tests outgrow compiled code."""
    return c.rlike("(?i)" + "|".join(map(re.escape, words)))


def like_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def route(query: Column) -> Column:
    """struct(intent, reason, strategy, complexity, tools, mode, memory_top_k, confidence): the first rule that holds,
    else knowledge_base."""
    q = strip(F.coalesce(query, F.lit("")))
    compact = F.regexp_replace(F.regexp_replace(q, r"\s+", ""), "^[。！？!?，,；;：:]+|[。！？!?，,；;：:]+$", "")
    talk = compact.isin(SMALL_TALK) | ((F.length(compact) <= 14) & has_any(compact, SMALL_TALK_PARTS))
    memory = (q.rlike(MEMORY_WRITE) | (like_any(q, MEMORY_CHAT) & ~has_any(q, NEWS))) & ~has_any(q, KNOWLEDGE + ENTITIES)
    brief = (F.length(q) <= 5) & ~has_any(q, STATISTICS + NEWS + STEPS + KNOWLEDGE)
    sql = has_any(q, STATISTICS) & has_any(q, ENTITIES) & ~has_any(q, STATISTICS_IN_DOCUMENTS)
    web = has_any(q, NEWS) & ~has_any(q, NEWS_IN_DOCUMENTS)
    steps = (F.length(q) >= LEAST_STEPS_CHARS) & has_any(q, STEPS)
    rules = [(q == "", "empty"), (talk, "small_talk"), (memory, "memory"), (brief, "brief"), (like_any(q, GREETINGS), "greeting"), (sql, "statistics"), (web, "news"), (steps, "steps")]
    reason = F.lit("default")
    for holds, name in reversed(rules):
        reason = F.when(holds, name).otherwise(reason)
    chat = ("chitchat", "chitchat", "simple", "", "chitchat", 5, 1.0)
    known = {name: chat for name in ("empty", "small_talk", "memory", "brief", "greeting")} | {
        "statistics": ("sql_query", "sql_query", "tool_required", "sql_query", "tool_call", 2, 1.0),
        "news": ("web_search", "web_search", "tool_required", "web_search", "tool_call", 2, 1.0),
        "steps": ("multi_step", "decomposition", "multi_step", "kb_search", "rag_workflow", 3, 1.0),
        "default": ("knowledge_base", "direct", "single_hop", "kb_search", "rag_workflow", 3, 0.5),
    }
    fields = ("intent", "strategy", "complexity", "tools", "mode", "memory_top_k", "confidence")
    rows = {name: F.struct(F.lit(name).alias("reason"), *(F.lit(v).alias(f) for f, v in zip(fields, values))) for name, values in known.items()}
    return F.element_at(F.create_map(*(x for name, row in rows.items() for x in (F.lit(name), row))), reason)


def clarification(query: Column) -> Column:
    """struct(needed, reason, slots, question) of vague references, with what to ask back; reason and question are ''
    where the query is clear. Small talk isn't asked back: see clarified."""
    c = F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", "")
    reason = (
        F.when(has_any(c, TWO_TARGETS), "missing_comparison_targets")
        .when(c.contains(WHICH_IS_BETTER) & ~c.rlike(CANDIDATES), "missing_candidates_and_criteria")
        .when(has_any(c, THIS_ONE), "ambiguous_reference")
        .when(has_any(c, VAGUE) & (F.length(c) <= 12), "short_ambiguous_reference")
        .otherwise("")
    )
    slots = F.when(reason == "missing_comparison_targets", "comparison_targets").when(reason == "missing_candidates_and_criteria", "candidates,criteria").when(reason != "", "referent").otherwise("")
    question = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ASK_BACK.items() for x in pair)), reason), F.lit(""))
    return F.struct((reason != "").alias("needed"), reason.alias("reason"), slots.alias("slots"), question.alias("question"))


def clarified(query: Column) -> Column:
    """clarification() of what is no small talk, which needs none."""
    c = clarification(query)
    nothing = [F.lit(False).alias("needed"), *(F.lit("").alias(f) for f in ("reason", "slots", "question"))]
    return F.when(route(query)["intent"] == "chitchat", F.struct(*nothing)).otherwise(c)


def rewrite(query: Column) -> Column:
    """struct(rewritten, keywords): formal phrases for colloquial ones, fillers dropped, white space collapsed."""
    c = strip(query)
    for old, new in FORMAL.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    for word in FILLERS:
        c = F.replace(c, F.lit(word), F.lit(""))
    c = F.coalesce(F.nullif(collapse(c), F.lit("")), query)
    words = F.regexp_extract_all(c, F.lit("([一-鿿]+|[a-zA-Z]+)"), F.lit(1))
    return F.struct(c.alias("rewritten"), F.when(F.size(words) > 0, words).otherwise(F.array(query)).alias("keywords"))


def decompose(query: Column, most: int = 4) -> Column:
    """array of sub-questions: one for each of up to three named entities of a comparison and one for both; else the
    parts between separators where there are two to `most`; else the query. Separators match in lower case only. What
    differs in case only is the same; a part of nothing but marks counts as a part and gives no question."""
    q = strip(F.coalesce(query, F.lit("")))
    names = F.array_distinct(F.regexp_extract_all(q, F.lit(ENTITY), F.lit(1)))
    names = F.filter(names, lambda x: ~x.isin(NO_ENTITIES))
    once = F.slice(_first_by_case(names), 1, max(2, most - 1))
    asked = F.transform(once, lambda x: F.concat(x, F.lit(ABOUT_ONE)))
    joint = F.concat(F.array_join(F.slice(once, 1, 2), " 和 "), F.lit(ABOUT_BOTH))
    by_name = F.slice(F.concat(asked, F.array(joint)), 1, most)
    parts = F.transform(F.filter(F.split(q, "|".join(SEPARATORS)), lambda x: strip(x) != ""), lambda x: F.regexp_replace(x, PART_ENDS, ""))
    by_part = _first_by_case(F.filter(F.transform(parts, lambda x: F.concat(x, F.lit(WHAT_IS))), lambda x: x != WHAT_IS))
    return F.when(q == "", F.array().cast("array<string>")).when(has_any(q, COMPARISONS) & (F.size(once) >= 2), by_name).when((F.size(parts) >= 2) & (F.size(parts) <= most) & (F.size(by_part) > 0), by_part).otherwise(F.array(q))


def _first_by_case(values: Column) -> Column:
    """The first of values that are equal but for case."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

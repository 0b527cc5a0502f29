"""Column functions over text, paths and page ranges. All stay in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: a search token is one CJK character or a Latin run; what ends a line; what blank means.
TOKEN = r"[一-鿿]|[A-Za-z0-9][A-Za-z0-9_.:/+\-]*"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANKS = " \t\n\x0b\f\r\u00a0\u3000"
BLANK = r"[\s 　]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """The stripped text, or null where nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{BLANK}+", " "))


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)


def bm25_tokens(c: Column) -> Column:
    """Lower-cased search tokens in order; an empty array for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def normalize_spaces(c: Column) -> Column:
    """Without zero-width characters; blanks collapsed, three or more line feeds as two, stripped."""
    c = F.regexp_replace(c, "[​﻿]", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_path(c: Column, docs_dir: str = "docs") -> Column:
    """Forward slashes, no doubles, without the documents folder in front and slashes at the ends."""
    c = F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\\", "/"), "/+", "/")
    if folder := docs_dir.replace("\\", "/").strip("/"):
        c = F.when(c.startswith(folder + "/"), F.substr(c, F.lit(len(folder) + 2))).otherwise(c)
    return F.regexp_replace(c, "^/+|/+$", "")


def slug(c: Column) -> Column:
    """Lower case, other than letters, digits and CJK as one underscore, none at the ends; 'document' if none is left."""
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(c, "^_+|_+$", ""), F.lit("")), F.lit("document"))


def derive_doc_id(path: Column, text: Column) -> Column:
    """The doc_id of the front matter's first 80 lines, else the path's slug."""
    head = F.slice(lines(F.coalesce(text, F.lit(""))), 1, 80)
    opened = strip(F.element_at(head, 1)) == "---"
    closing = F.array_position(F.transform(F.slice(head, 2, 79), strip), "---")
    inside = F.when(closing > 0, F.slice(head, 2, (closing - 1).cast("int"))).otherwise(F.slice(head, 2, 79))
    named = F.filter(inside, lambda x: strip(x).startswith("doc_id:"))
    value = F.regexp_replace(strip(F.regexp_replace(F.get(named, F.lit(0)), r"^\s*doc_id:", "")), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.when(opened, F.nullif(value, F.lit(""))), slug(path))


def char_grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text without white space; a short text is one gram, an empty none."""
    c = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{BLANK}+", ""))
    size = F.length(c)
    many = F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass; substr() would walk from the start each time
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(c)).otherwise(F.array_distinct(many))


def overlap_of(a: Column, b: Column) -> Column:
    """Overlap coefficient of two gram sets; 0 where either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def evidence_overlap(a: Column, b: Column, n: int = 3) -> Column:
    return overlap_of(char_grams(a, n), char_grams(b, n))


def page_numbers(c: Column) -> Column:
    """Sorted distinct pages of a text like '3, 5-7; 9'; bounds in either order; parts without digits are skipped."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[,，;；\s]+")
    pages = F.transform(parts, _pages_of)
    return F.array_sort(F.array_distinct(F.flatten(pages)))


def _pages_of(part: Column) -> Column:
    bound = lambda i: F.regexp_extract(part, r"(\d+)\s*[-–—]\s*(\d+)", i).try_cast("int")
    one = F.regexp_extract(part, r"(\d+)", 1).try_cast("int")
    spread = F.sequence(F.least(bound(1), bound(2)), F.greatest(bound(1), bound(2)))
    return F.when(bound(1).isNotNull() & bound(2).isNotNull(), spread).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<int>"))


def page_range(pages: Column) -> Column:
    """'a-b', 'a', or '' for an array of pages."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def table_cells(c: Column) -> Column:
    """Rows of a Markdown table: arrays of stripped cells, without separator and empty rows."""
    rows = F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), strip), lambda x: x.startswith("|") & x.endswith("|"))
    rows = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), strip))
    dashes = lambda cells: F.forall(cells, lambda x: x.rlike("^:?-{3,}:?$"))
    return F.filter(rows, lambda cells: ~dashes(cells) & F.exists(cells, lambda x: x != ""))


def table_header(cells: Column) -> Column:
    """The first row, lower-cased with white space collapsed; an empty array without rows."""
    return F.coalesce(F.transform(F.get(cells, F.lit(0)), lambda x: F.lower(collapse(x))), F.array().cast("array<string>"))


def column_count(c: Column, cells: Column | None = None) -> Column:
    """Most cells of a Markdown row; without such rows, most parts of a line split at two blanks or tabs. cells are the
    text's table_cells, where they are at hand."""
    cells = table_cells(c) if cells is None else cells
    plain = F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), strip), lambda x: x != "")
    widths = F.when(F.size(cells) > 0, F.transform(cells, F.size)).otherwise(F.transform(plain, lambda x: F.size(F.split(x, r"\s{2,}|\t+"))))
    return F.coalesce(F.array_max(widths), F.lit(0))


def table_width(cells: Column) -> Column:
    """Most cells of a row."""
    return F.array_max(F.transform(cells, F.size))


def table_text(cells: Column, width: Column | None = None) -> Column:
    """Rows as a Markdown table, short rows filled up; '' without rows. Each row is filled up to table_width(cells): give
    it and cells as columns of a table where they have many rows, so that no row works them out again."""
    width = table_width(cells) if width is None else width
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), row)
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.array(row(F.get(cells, F.lit(0))), rule), body), "\n")).otherwise("")


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not blank, stripped; '' if all are."""
    return F.coalesce(*(filled(c) for c in candidates), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def llm_json(c: Column) -> Column:
    """The JSON object inside a model's answer: without code fences, from the first brace to the last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    c = F.when(c.contains("```") & (fenced != ""), fenced).otherwise(c)
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?s)^[^{]*(?=\{)", ""), r"(?s)(?<=\})[^}]*$", ""))


#: Fixed unit words, in the order they are looked for.
UNITS = [("千元", ["（千元）", "(千元)", "单位：千元"]), ("百万元", ["人民币百万元", "单位：百万元", "（百万元）", "(百万元)"]), ("元", ["单位：元", "（元）", "(元)"])]
NO_UNIT = "以报告披露单位为准"


def detect_unit(c: Column) -> Column:
    found = F.lit(NO_UNIT)
    for unit, words in reversed(UNITS):
        found = F.when(contains_any(c, words), unit).otherwise(found)
    return found


def to_decimal(c: Column) -> Column:
    """A number with thousands separators as decimal(38,6); null where it is none."""
    return F.regexp_replace(strip(c), "[,，%]", "").try_cast("decimal(38,6)")


def safe_title(c: Column, most: int = 120) -> Column:
    """Tags dropped, characters that file names can't have as _, white space collapsed, clipped."""
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r'[\\/:*?"<>|]', "_")
    return clip(collapse(c), most)


def report_date(c: Column) -> Column:
    """yyyy-MM-dd of epoch seconds, epoch milliseconds or a text that begins with a date."""
    n = c.try_cast("bigint")
    seconds = F.when(n > 10_000_000_000, (n / 1000).cast("bigint")).otherwise(n)
    return F.when(n.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(clip(c, 10))

"""Cleaning of parsed document blocks. A document's blocks are ordered by block_index; everything here partitions by
doc_id, so one exchange serves a whole chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T

#: Fixed patterns and words of the noise rules.
PAGE_NUMBERS = [r"(?i)^\d{1,4}$", r"(?i)^[-–—]\s*\d{1,4}\s*[-–—]$", r"(?i)^\d{1,4}\s*/\s*\d{1,4}$", r"(?i)^(page|p\.)\s*\d{1,4}$", r"^第\s*\d{1,4}\s*页$", r"^页码\s*\d{1,4}$"]
CONTENTS = ["目录", "contents", "table of contents"]
NAVIGATION = ["home", "menu", "login", "logout", "register", "search", "back to top", "more", "首页", "菜单", "登录", "退出", "注册", "搜索", "返回顶部", "更多"]
HEADINGS = [r"^第[一二三四五六七八九十百千万\d]+[章节篇部卷](?U)\b", r"^\d+(\.\d+)*[、.．\s]+", r"^[一二三四五六七八九十]+[、.．]\s*"]


def by_doc():
    return Window.partitionBy("doc_id").orderBy("block_index")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def any_like(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.rlike(p) for p in patterns))


def filter_noise_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised text, less blanks and what each file type counts as noise."""
    text, kind, suffix = F.col("text"), F.col("block_type"), F.lower("file_type")
    private = F.length(text) - F.length(F.regexp_replace(text, r"[-]", ""))
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    formula = (private > 0) & ~text.rlike("[一-鿿]") & ((visible <= 4) | ((F.length(text) <= 120) & (letters <= 30)))
    contents = F.lower(text).isin(CONTENTS) | ((F.length(text) <= 120) & text.rlike(r"\.{3,}\s*\d{1,4}$"))
    navigation = (F.length(text) <= 30) & F.lower(text).isin(NAVIGATION)
    noise = F.when(suffix == ".pdf", any_like(text, PAGE_NUMBERS) | formula).when(suffix == ".docx", (kind != "table") & contents).when(suffix.isin(".html", ".htm"), (kind != "table") & navigation).otherwise(False)
    return blocks.withColumn("text", T.normalize_spaces(F.coalesce("text", F.lit("")))).where(text != "").where(~noise)


def remove_repeated_lines(blocks: DataFrame, min_pages: int = 3, most_chars: int = 40, least_ratio: float = 0.6) -> DataFrame:
    """Blocks less running headers and footers: short lines whose occurrences are at least least_ratio of their
    document's pages. Blocks left empty go; blocks without text stay."""
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages")).where(F.col("pages") >= min_pages)
    filled = blocks.where("text is not null and text <> ''")
    flat = filled.select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("line", T.strip(F.col("line"))).where((F.col("line") != "") & (F.length("line") <= most_chars))
    repeated = flat.groupBy("doc_id", "line").agg(F.count("*").alias("n")).join(pages, "doc_id").where(F.col("n") / F.col("pages") >= least_ratio)
    repeated = repeated.groupBy("doc_id").agg(F.collect_set("line").alias("repeated"))
    rows = blocks.join(repeated, "doc_id", "left")
    kept = F.filter(T.lines(F.col("text")), lambda x: (T.strip(x) != "") & ~F.array_contains("repeated", T.strip(x)))
    rows = rows.withColumn("touched", F.col("repeated").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    text = F.when(F.col("touched"), T.strip(F.array_join(kept, "\n"))).otherwise(F.col("text"))
    return rows.withColumn("text", text).where(~F.col("touched") | (F.col("text") != "")).drop("repeated", "touched")


def merge_title_fragments(blocks: DataFrame, short: int = 2, long: int = 40) -> DataFrame:
    """Runs of titles of one or two characters go in front of the next title, or become a text block in front of what
    else follows; titles of `long` characters are text. block_index keeps its order; a new text block takes the index of
    the fragment that ends its run."""
    text = F.when(F.coalesce("text", F.lit("")) != "", T.normalize_spaces(F.col("text"))).otherwise(F.col("text"))
    rows = blocks.withColumn("text", text)
    size = F.length(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("fragment", (F.col("block_type") == "title") & (size > 0) & (size <= short))
    island = F.coalesce(F.sum((~F.col("fragment")).cast("int")).over(by_doc().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("island", island)
    inside = Window.partitionBy("doc_id", "island").orderBy("block_index")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.array_join(F.transform(F.filter(F.collect_list(F.struct("fragment", "text")).over(whole), lambda x: x["fragment"]), lambda x: x["text"]), "")
    rows = rows.withColumn("carry", carried).withColumn("head", F.last("fragment").over(whole)).withColumn("head_title", (F.last("block_type").over(whole) == "title") & ~F.col("head")).withColumn("tail", F.lead("fragment").over(inside))
    demoted = F.col("fragment") & ~F.coalesce(F.col("tail"), F.lit(False)) & ~F.col("head_title")
    joined = ~F.col("fragment") & (F.col("block_type") == "title") & (F.col("carry") != "")
    rows = rows.where(~F.col("fragment") | demoted)
    new_text = F.when(demoted, F.col("carry")).when(joined, F.concat("carry", "text")).otherwise(F.col("text"))
    kind = F.when(demoted, "text").when((F.col("block_type") == "title") & (F.length(new_text) >= long), "text").otherwise(F.col("block_type"))
    return rows.withColumns({"block_type": kind, "text": new_text}).drop("fragment", "island", "carry", "head", "head_title", "tail")


def fix_titles(blocks: DataFrame, short: int = 2, long: int = 40, indent: float = 12.0, gap: float = 18.0) -> DataFrame:
    """Neighbouring titles of a page are one where their boxes line up or, without boxes, either is short; titles that
    are long or read like sentences become text. A merged title keeps the first one's index and columns."""
    text = T.strip(F.coalesce("text", F.lit("")))
    rows = blocks.withColumn("t", text)
    before = lambda c: F.lag(c).over(by_doc())
    boxes = F.col("bbox").isNotNull() & before("bbox").isNotNull()
    near = (F.abs(before("bbox")["x"] - F.col("bbox")["x"]) <= indent) & (F.abs(before("bbox")["y"] + before("bbox")["h"] - F.col("bbox")["y"]) <= gap)
    brief = (F.length(before("t")) <= short) | (F.length("t") <= short)
    goes_on = (F.col("block_type") == "title") & (before("block_type") == "title") & before("page_no").eqNullSafe(F.col("page_no")) & (F.col("t") != "") & (before("t") != "") & F.when(boxes, near).otherwise(brief)
    rows = rows.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("starts").over(so_far()))
    whole = Window.partitionBy("doc_id", "island").orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("joined", F.array_join(F.collect_list("t").over(whole), "")).where("starts = 1")
    title = F.col("block_type") == "title"
    sentence = (F.length("joined") >= long) | T.contains_any(F.col("joined"), ["。", "；", "，", ","])
    return rows.withColumn("text", F.when(title, F.col("joined")).otherwise(F.col("text"))).withColumn("block_type", F.when(title & sentence, "text").otherwise(F.col("block_type"))).drop("t", "starts", "island", "joined")


def text_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_index, block_type, text): headings are titles, other lines gather into paragraphs that a blank
    line or a heading ends. A front matter between two --- lines at the top is left out."""
    lines = T.lines(F.coalesce(F.col(text_col), F.lit("")))
    opened = T.strip(F.get(lines, F.lit(0))) == "---"
    closing = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), T.strip), "---")
    body = F.when(opened & (closing > 0), F.slice(lines, (closing + 2).cast("int"), F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(body).alias("block_index", "raw")).withColumn("line", T.strip(F.col("raw")))
    heading = F.col("line").startswith("#") | ((F.length("line") <= 80) & any_like(F.col("line"), HEADINGS))
    rows = rows.withColumn("heading", (F.col("line") != "") & heading).withColumn("ends", (F.col("line") == "") | F.col("heading"))
    island = F.sum((F.col("ends") | F.coalesce(F.lag("ends").over(by_doc()), F.lit(True))).cast("int")).over(so_far())
    rows = rows.withColumn("island", island).where("line <> ''")
    got = rows.groupBy("doc_id", "island").agg(F.bool_or("heading").alias("heading"), F.min("block_index").alias("at"), F.array_sort(F.collect_list(F.struct("block_index", "line"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["line"]), "\n")
    text = F.when(F.col("heading"), T.strip(F.regexp_replace(joined, "^#+", ""))).otherwise(joined)
    got = got.select("doc_id", "at", F.when(F.col("heading"), "title").otherwise("text").alias("block_type"), text.alias("text")).where("text <> ''")
    return got.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("block_index"), "block_type", "text")


def block_section_text(blocks: DataFrame) -> DataFrame:
    """Adds section_text: titles as ##, list items as -, tables under their markers."""
    text = T.strip(F.coalesce("text", F.lit("")))
    m = F.col("extra")
    name, pages, heads = (T.filled(m[k]) for k in ("table_id", "page_range", "headers"))
    marker = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(f"[{label}: "), v, F.lit("]")))
    table = T.strip(F.coalesce(F.nullif("html", F.lit("")), "text", F.lit("")))
    marked = F.when(name.isNotNull(), F.concat_ws("\n", marker("TABLE_ID", name), marker("TABLE_PAGE_RANGE", pages), marker("TABLE_HEADERS", heads), table)).otherwise(table)
    line = F.when(F.col("block_type") == "table", T.strip(marked)).when(F.col("block_type") == "title", F.concat(F.lit("## "), text)).when(F.col("block_type") == "list_item", F.concat(F.lit("- "), text)).otherwise(text)
    return blocks.withColumn("section_text", line)


def merge_cross_page_tables(blocks: DataFrame) -> DataFrame:
    """Blocks with table continuations merged: neighbouring tables on following pages with as many columns, and the
    same header, or a continuation word in front, or a header on the left only. Tables are numbered by document;
    extra gets table_id, page_range, headers, row_count, table_part_count."""
    rows = blocks.withColumn("cells", T.table_cells(F.col("text"))).withColumn("header", T.table_header(F.col("cells"))).withColumn("cols", T.column_count(F.col("text"), F.col("cells")))
    before = lambda c: F.lag(c).over(by_doc())
    table = F.col("block_type") == "table"
    follows = table & (before("block_type") == "table") & before("source_path").eqNullSafe(F.col("source_path")) & (F.col("page_no") == before("page_no") + 1) & (F.col("cols") > 0) & (F.col("cols") == before("cols"))
    same = (F.size("header") > 0) & (F.col("header") == before("header"))
    word = T.strip(F.lower(F.coalesce("text", F.lit("")))).rlike(r"^(continued|cont\.|续表)")
    left_only = (F.size(before("header")) > 0) & (F.size("header") == 0)
    rows = rows.withColumn("starts", (~F.coalesce(follows & (same | word | left_only), F.lit(False))).cast("int")).withColumn("island", F.sum("starts").over(so_far()))
    first = F.first("header").over(Window.partitionBy("doc_id", "island").orderBy("block_index"))
    rows = rows.withColumn("first_header", first)
    kept = F.when((F.col("starts") == 0) & (F.col("header") == F.col("first_header")), F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1)))).otherwise(F.col("cells"))
    rows = rows.withColumn("kept", kept)
    got = rows.groupBy("doc_id", "island").agg(
        F.min("block_index").alias("block_index"), F.first("block_type").alias("block_type"), F.min_by("source_path", "block_index").alias("source_path"), F.min_by("html", "block_index").alias("html"), F.min_by("extra", "block_index").alias("extra"), F.min("page_no").alias("page_no"),
        F.array_sort(F.collect_list(F.struct("block_index", "text", "kept", "page_no"))).alias("parts"), F.min(F.size("cells") > 0).alias("markdown"), F.count("*").alias("n"),
    )
    table = F.col("block_type") == "table"
    got = got.withColumn("all_rows", F.flatten(F.transform("parts", lambda x: x["kept"]))).withColumn("width", T.table_width(F.col("all_rows")))
    texts = F.array_join(F.filter(F.transform("parts", lambda x: T.strip(F.coalesce(x["text"], F.lit("")))), lambda x: x != ""), "\n\n")
    text = F.when(table & F.col("markdown"), T.table_text(F.col("all_rows"), F.col("width"))).when(table, texts).otherwise(F.col("parts")[0]["text"])
    got = got.withColumn("text", text).withColumn("table_no", F.sum(table.cast("int")).over(so_far()) - 1)
    got = got.withColumn("shown", T.table_cells(F.col("text"))).drop("all_rows", "width")
    shown = F.col("shown")
    facts = F.map_from_arrays(
        F.array(*map(F.lit, ("table_id", "page_range", "headers", "row_count", "table_part_count", "is_cross_page_table"))),
        F.array(F.concat_ws("::", F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown_doc")), F.lit("table"), F.col("table_no").cast("string")), T.page_range(F.array_compact(F.transform("parts", lambda x: x["page_no"]))), F.array_join(F.coalesce(F.get(shown, F.lit(0)), F.array().cast("array<string>")), ", "), F.greatest(F.size(shown) - 1, F.lit(0)).cast("string"), F.col("n").cast("string"), (F.size(F.array_distinct(F.transform("parts", lambda x: x["page_no"]))) > 1).cast("string")),
    )
    own = F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(facts), k))
    return got.withColumn("extra", F.when(table, F.map_concat(own, facts)).otherwise(F.col("extra"))).withColumn("html", F.when(table & F.col("markdown"), F.lit(None)).otherwise(F.col("html"))).select("doc_id", "block_index", "block_type", "text", "page_no", "source_path", "html", "extra")


#: Fixed texts of the quality report, and its bounds: share of blocks without a page, characters of a sparse document.
FLAGS = ["scanned_pdf_requires_ocr", "table_blocks_present", "cross_page_table_candidate", "image_blocks_present", "missing_page_metadata", "empty_parse_result", "very_sparse_text"]
MISSING_SHARE, SPARSE_CHARS = 0.5, 200


def block_quality(blocks: DataFrame, probes: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """One row a document: blocks by type, pages, blocks without a page, cross-page table candidates (a table whose
    page follows that of the table before it), mean length of blocks with text, flags and level.

    probes (doc_id, is_scanned) marks scans; documents (doc_id) brings in those that gave no block at all. Both, and
    only both, are poor; any other flag asks for a review."""
    kind, page, size = F.col("block_type"), F.col("page_no"), F.length(T.strip(F.coalesce("text", F.lit(""))))
    table_before = F.last(F.when(kind == "table", F.struct("page_no")), ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.select("doc_id", "block_type", "page_no", size.alias("size"), F.coalesce((kind == "table") & (page == table_before["page_no"] + 1), F.lit(False)).alias("candidate"))
    of = lambda k: F.count_if(kind == k)
    sums = {"blocks": F.count("*"), "titles": of("title"), "texts": of("text"), "list_items": of("list_item"), "tables": of("table"), "images": of("image"), "pages": F.countDistinct("page_no"), "missing_pages": F.count_if(page.isNull()), "table_candidates": F.count_if("candidate"), "with_text": F.count_if(F.col("size") > 0), "chars": F.sum("size")}
    got = rows.groupBy("doc_id").agg(*(v.alias(k) for k, v in sums.items()), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))
    if documents is not None:
        got = documents.select("doc_id").distinct().join(got, "doc_id", "left").fillna(0, list(sums))
    scanned = F.lit(False)
    if probes is not None:
        got, scanned = got.join(probes.select("doc_id", "is_scanned"), "doc_id", "left"), F.coalesce("is_scanned", F.lit(False))
    n = {k: F.col(k) for k in sums}
    holds = [scanned, n["tables"] > 0, n["table_candidates"] > 0, n["images"] > 0, (n["blocks"] > 0) & (n["missing_pages"] >= MISSING_SHARE * n["blocks"]), n["blocks"] == 0, (n["with_text"] > 0) & (n["chars"] < SPARSE_CHARS)]
    flags = F.array_join(F.array_compact(F.array(*(F.when(h, name) for h, name in zip(holds, FLAGS)))), ",")
    level = F.when((n["blocks"] == 0) | scanned, "poor").when(flags != "", "needs_review").otherwise("ok")
    pages = F.when(F.col("first_page").isNull(), "").when(F.col("first_page") == F.col("last_page"), F.col("first_page").cast("string")).otherwise(F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string")))
    mean = F.when(n["with_text"] > 0, F.round(n["chars"] / n["with_text"], 2)).otherwise(0.0)
    return got.select("doc_id", "blocks", "titles", "texts", "list_items", "tables", "images", "pages", pages.alias("page_range"), "missing_pages", "table_candidates", mean.alias("mean_chars"), flags.alias("flags"), level.alias("level"))


def pdf_text_probe(pages: DataFrame, probe: int = 3, least_chars: int = 100) -> DataFrame:
    """(doc_id, probe_chars, is_scanned): stripped characters of the first pages; too few mean a scan."""
    got = pages.where(F.col("page_no") <= probe).groupBy("doc_id").agg(F.sum(F.length(T.strip(F.coalesce("text", F.lit(""))))).alias("probe_chars"))
    return got.withColumn("is_scanned", F.col("probe_chars") < least_chars)


def page_summary(pages: DataFrame) -> DataFrame:
    size = F.length(T.strip(F.coalesce("text", F.lit(""))))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(size).alias("chars"), F.sum(F.when(size == 0, 1).otherwise(0)).alias("empty_pages"))


def ordered_text(rows: DataFrame, by: str, order: str, line: Column, name: str, sep: str = "\n") -> DataFrame:
    """One text for each `by`: its lines in order."""
    got = rows.select(by, F.col(order).alias("o"), line.alias("line")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("o", "line"))).alias("rows"))
    return got.select(by, F.array_join(F.transform("rows", lambda x: x["line"]), sep).alias(name))


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): page texts under '## Page n', empty pages left out."""
    rows = pages.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    return ordered_text(rows, "doc_id", "page_no", F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("text")), "markdown", "\n\n")


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): blocks in order, blank ones too. A rule and a heading come where the page changes, before each
    block a comment with its place and type, and a table stands as its HTML where it has some."""
    order = by_doc()
    last = F.last("page_no", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    text, html = F.coalesce("text", F.lit("")), F.nullif("html", F.lit("")) if "html" in blocks.columns else F.lit(None).cast("string")
    turn = F.when(F.col("page_no").isNotNull() & ~F.col("page_no").eqNullSafe(last), F.concat(F.lit("\n---\n\n## Page "), F.col("page_no").cast("string"), F.lit("\n"))).otherwise("")
    comment = F.concat(F.lit("<!-- block_index="), (F.row_number().over(order) - 1).cast("string"), F.lit(" block_type="), F.col("block_type"), F.lit(" -->\n"))
    body = F.when(F.col("block_type") == "title", F.concat(F.lit("## "), text)).when(F.col("block_type") == "list_item", F.concat(F.lit("- "), text)).when(F.col("block_type") == "table", F.coalesce(html, text)).otherwise(text)
    rows = ordered_text(blocks.withColumn("line", F.concat(turn, comment, body, F.lit("\n"))), "doc_id", "block_index", F.col("line"), "markdown", "")
    return rows.withColumn("markdown", F.concat(T.strip(F.col("markdown")), F.lit("\n")))


def with_audit_header(markdown: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, markdown) with a front matter of doc_id and source_path, which front_matter reads back."""
    head = F.concat(F.lit("---\ndoc_id: "), F.col("doc_id").cast("string"), F.lit("\nsource_path: "), F.coalesce("source_path", F.lit("")), F.lit("\n---\n\n"))
    return markdown.join(paths.select("doc_id", "source_path"), "doc_id", "left").select("doc_id", F.concat(head, "markdown").alias("markdown"))


def front_matter(text: Column) -> Column:
    """struct(fields map<string,string>, body): the keys and values between two lines of dashes at a text's beginning,
    values without quotes around them, of equal keys the last; a text without such lines is all body, without fields."""
    block = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 0)
    inside = F.regexp_replace(F.regexp_replace(block, r"\A---[ \t]*\r?\n", ""), r"\r?\n---[ \t]*(?:\r?\n)?\z", "")
    pairs = F.filter(F.split(inside, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    key = lambda x: T.strip(F.regexp_extract(x, r"^([^:]*):", 1))
    value = lambda x: F.regexp_replace(T.strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", "")
    names = F.transform(pairs, key)
    kept = F.filter(F.transform(pairs, lambda x, i: F.struct(key(x).alias("key"), value(x).alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names) + 1), e["key"]))
    fields = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))
    return F.struct(F.when(block == "", F.create_map().cast("map<string,string>")).otherwise(fields).alias("fields"), F.substr(text, F.length(block) + 1).alias("body"))

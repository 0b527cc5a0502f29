"""HTML and DOCX contents as block rows. Parsing needs order and state, so it runs in Arrow batches, a row a block."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed sets of tags: subtrees that are left out, tags that hold text, tags that are titles.
SKIPPED = frozenset(["script", "style", "noscript", "nav", "footer", "header"])
TITLES = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "title"])
TEXTS = frozenset(["p", "div", "section", "article", "main"])
#: Rows whose contents and blocks a Python worker holds at a time.
SLICE = 64
BLOCK = "block_index int, block_type string, text string, tag string, error string"
Blocks = list[tuple[str, str, str]]  # type, text, tag


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, so that a worker holds Python objects of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def markdown_rows(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, the first as its header; short rows are filled up."""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


class _Events(HTMLParser):
    """Tags and texts of a page outside the skipped subtrees, as a flat list of (kind, value)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.href, self.out = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1
        elif not self.depth:
            self.href = dict(attrs).get("href") if tag == "a" else self.href
            self.out.append(("open", tag))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif not self.depth:
            self.href = None if tag == "a" else self.href
            self.out.append(("close", tag))

    def handle_data(self, data):
        if not self.depth:
            self.out.append(("text", f"{data} ({self.href})" if self.href and data.strip() else data))


def html_events(page: str) -> list[tuple[str, str]]:
    parser = _Events()
    parser.feed(page)
    parser.close()
    return parser.out


def blocks_of_html(page: str) -> Blocks:
    """Titles, list items, texts and tables in order; a text ends where its tag closes or another block opens."""
    out: Blocks = []
    tag, parts, rows, cell = None, [], None, None

    def end_text():
        nonlocal tag
        if tag and (text := squeeze(parts)):
            out.append(("title" if tag in TITLES else "list_item" if tag == "li" else "text", text, tag))
        tag = None
        parts.clear()

    def end_table():
        nonlocal rows, cell
        if rows and (filled := [r for r in rows if any(r)]):
            out.append(("table", markdown_rows(filled), "table"))
        rows, cell = None, None

    for kind, value in html_events(page):
        if kind == "text":
            if cell is not None:
                cell.append(value)
            elif tag:
                parts.append(value)
        elif kind == "open":
            if value == "table":
                end_text()
                end_table()
                rows = []
            elif value == "tr" and rows is not None:
                rows.append([])
            elif value in ("td", "th") and rows:
                cell = []
            elif value in TITLES or value in TEXTS or value == "li":
                if value == tag:
                    parts.clear()
                else:
                    end_text()
                tag = value
        elif value in ("td", "th") and cell is not None:
            rows[-1].append(squeeze(cell))
            cell = None
        elif value == "table":
            end_table()
        elif value == tag:
            end_text()
    end_text()
    end_table()
    return out


def markdown_of_html(page: str, title: str = "") -> str:
    """Headings, paragraphs, list items and tables as Markdown under a title line; the whole text if there are none."""
    prefix = {"h1": "# ", "title": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "#### ", "h6": "#### ", "li": "- "}
    lines = [prefix.get(tag, "") + text for _, text, tag in blocks_of_html(page)]
    body = "\n\n".join(lines) or squeeze([v for k, v in html_events(page) if k == "text"])
    return f"---\ntitle: {title}\n---\n\n{body}" if title else body


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def blocks_of_docx(data: bytes) -> Blocks:
    """Paragraphs by style (heading or title, list, else text) and tables of a DOCX file's body, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text_of = lambda node: squeeze(["".join(t.text or "" for t in node.iter(f"{W}t"))])
    out: Blocks = []
    for node in body if body is not None else []:
        if node.tag == f"{W}tbl":
            rows = [[text_of(c) for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
            if rows := [r for r in rows if any(r)]:
                out.append(("table", markdown_rows(rows), "tbl"))
        elif node.tag == f"{W}p" and (text := text_of(node)):
            style = node.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val", "") if style is not None else "").lower()
            listed = "list" in name or node.find(f"{W}pPr/{W}numPr") is not None
            out.append(("title" if name.startswith(("heading", "title")) else "list_item" if listed else "text", text, name or "p"))
    return out


def parsed_blocks(files: DataFrame, id_col: str, content_col: str, parse: Callable[..., Blocks]) -> DataFrame:
    """(doc_id, block_index, block_type, text, tag, error): a row a block. Null content gives no row; content that
    can't be parsed gives one row with the error, so a broken file doesn't fail its batch."""
    kind = files.schema[id_col].dataType.simpleString()
    types = [pa.int32(), *[pa.string()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, rows = [], []
            for i, content in enumerate(batch.column(1).to_pylist()):
                if content is None:
                    continue
                try:
                    own = [(k, *b, None) for k, b in enumerate(parse(content))]
                except Exception as e:  # noqa: BLE001
                    own = [(0, None, None, None, f"{type(e).__name__}: {e}")]
                owner += [i] * len(own)
                rows += own
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], ["doc_id", "block_index", "block_type", "text", "tag", "error"])

    return files.select(F.col(id_col).alias("doc_id"), content_col).mapInArrow(run, f"doc_id {kind}, {BLOCK}")


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return parsed_blocks(pages, id_col, html_col, blocks_of_html)


def docx_blocks(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    return parsed_blocks(files, id_col, content_col, blocks_of_docx)


def html_to_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", title_col: str = "url") -> DataFrame:
    """(id, markdown) of each page; null for a null page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [None if h is None else markdown_of_html(h, t or "") for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "markdown"])

    return pages.select(id_col, html_col, title_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, markdown string")

"""Sections and hierarchical chunks: order-dependent packing, one document at a time in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.parsing import markdown_rows, slices

SECTION = "section_index int, section_title string, text string, page_range string, element_type string, first_block int, last_block int"
CHUNK = "chunk_id string, parent_id string, chunk_role string, level int, ordinal int, text string"
#: What a heading that starts a chapter begins with; body characters above which such headings stay apart.
STRONG = re.compile(r"第|§|Chapter|CHAPTER|Part|PART|\d+\s+")
BODY_CHARS = 120
#: Fixed value: most rounds of joining brief sections.
ROUNDS = 5
UNIT = re.compile(r"[一-鿿]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_一-鿿]")
#: Fixed value: the pattern by which a byte-level tokenizer splits text before it merges.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The characters by which such a tokenizer writes bytes: printable ones as they are, the others from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Characters that all versions of Unicode class alike, and pieces whose counts a worker remembers.
PLAIN = re.compile(r"[\x00-\x1b\x20-\u052f\u2000-\u206f]*")
REMEMBERED = 200_000
SENTENCE = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？]+|\n+|$)\s*")


def per_document(rows: DataFrame, columns: list[str], expand: Callable[..., list[tuple]] | None, schema: str, start: Callable | None = None) -> DataFrame:
    """Runs expand(*values) on each row's columns; its tuples are the rows of schema, after doc_id. start() may give
    expand once a task instead, where it needs something loaded. A batch goes through a few rows at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start() if start else expand
        for batch in slices(batches):
            owner, out = [], []
            for i, values in enumerate(zip(*(batch.column(k + 1).to_pylist() for k in range(len(columns))))):
                own = step(*values)
                owner += [i] * len(own)
                out += own
            filled = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *filled], ["doc_id", *names])

    return rows.select("doc_id", *columns).mapInArrow(run, f"doc_id {kind}, {schema}")


class _Section:
    """Blocks of one section with a running length."""

    def __init__(self, title: str = ""):
        self.title, self.lines, self.kinds, self.pages, self.at, self.size = title, [], [], [], [], 0
        self.joined_kind = ""

    def add(self, index: int, kind: str, line: str, page: int | None) -> None:
        self.lines.append(line)
        self.kinds.append(kind)
        self.at.append(index)
        self.size += len(line)
        if page is not None:
            self.pages.append(page)

    def text(self) -> str:
        return "\n\n".join(self.lines).strip()

    def body(self) -> int:
        """Characters beside the title's line."""
        return len(self.text()) - (len(self.title) + 3 if self.title and self.kinds[0] == "title" else 0)

    def kind(self) -> str:
        """Of a section that was joined the first part's type, or the next one's where that is a title."""
        if self.joined_kind:
            return self.joined_kind
        rest = [k for k in self.kinds if k != "title"] or self.kinds
        return max(sorted(set(rest), key=rest.index), key=rest.count)

    def __add__(self, other: _Section) -> _Section:
        out = _Section(self.title or other.title)
        out.lines, out.kinds, out.pages, out.at = (getattr(self, f) + getattr(other, f) for f in ("lines", "kinds", "pages", "at"))
        out.size = self.size + other.size
        out.joined_kind = self.kind() if self.kind() != "title" else other.kind()
        return out


def pack_sections(blocks: list[dict[str, Any]], most: int, least: int) -> list[tuple]:
    """A title begins a section, and so does a block that would carry one past `most` characters (the title goes
    along). Then sections below `least` characters are joined to their neighbours, see joined_rounds."""
    sections: list[_Section] = []
    for b in blocks:
        line, title = b["section_text"], b["block_type"] == "title"
        if not line:
            continue
        if title or not sections or sections[-1].size + len(line) > most:
            name = (b["text"] or "").strip() if title else sections[-1].title if sections else ""
            sections.append(_Section(name))
        sections[-1].add(b["block_index"], b["block_type"], line, b["page_no"])
    pages = lambda p: "" if not p else str(min(p)) if min(p) == max(p) else f"{min(p)}-{max(p)}"
    return [(k, s.title, s.text(), pages(s.pages), s.kind(), s.at[0], s.at[-1]) for k, s in enumerate(joined_rounds(sections, least, ROUNDS))]


def joined_rounds(sections: list[_Section], least: int, rounds: int) -> list[_Section]:
    """The sections after as many rounds of joining, or fewer if one changes nothing.

    In a round a brief section waits for what follows and takes it in; where a chapter begins there, it goes to the
    section before it instead, unless it begins a chapter itself; else it stays. What was joined in a round neither
    waits nor is looked at again until the next one."""
    waiting: _Section | None = None
    settled: list[_Section] = []
    for section in sections:
        if waiting and not _chapters(waiting, section):
            settled.append(waiting + section)
            waiting = None
        else:
            _settle(settled, waiting)
            waiting = section if len(section.text()) < least else None
            settled += [] if waiting else [section]
    _settle(settled, waiting)
    return settled if rounds == 1 or len(settled) == len(sections) else joined_rounds(settled, least, rounds - 1)


def _settle(settled: list[_Section], brief: _Section | None) -> None:
    """A brief section that takes nothing in goes to the one before it, or after it."""
    if brief and settled and not _chapters(settled[-1], brief):
        brief = settled.pop() + brief
    settled += [brief] if brief else []


def _chapters(before: _Section, after: _Section) -> bool:
    """Whether a chapter heading parts two sections that have bodies and headings of their own."""
    bodies = min(before.body(), after.body())
    return bodies > BODY_CHARS and before.title not in ("", after.title) and bool(STRONG.match(after.title))


def build_sections(blocks: DataFrame, most_chars: int = 4000, least_chars: int = 800) -> DataFrame:
    """(doc_id, section_index, section_title, text, page_range, element_type, first_block, last_block) of blocks with a
    section_text. A document's blocks meet in one row; a section is cut where they are."""
    rows = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_type", "text", "section_text", F.col("page_no").cast("int").alias("page_no")))).alias("blocks"))
    return per_document(rows, ["blocks"], lambda b: pack_sections(b, most_chars, least_chars), SECTION)


def pack_units(pieces: list[tuple[str, int]], budget: int, overlap: int) -> list[list[tuple[str, int]]]:
    """Runs of pieces (text, units) of at most budget units; each begins with the last run's end of up to overlap
    units. A piece above the budget is a run of its own."""
    out: list[list[tuple[str, int]]] = []
    now: list[tuple[str, int]] = []
    size = fresh = 0
    for piece in pieces:
        if fresh and size + piece[1] > budget:
            out.append(now)
            keep, held = [], 0
            for p in reversed(now):
                if held + p[1] > min(overlap, max(0, budget - piece[1])):
                    break
                keep.insert(0, p)
                held += p[1]
            now, size, fresh = keep, held, 0
        now.append(piece)
        size += piece[1]
        fresh += 1
    return [*out, now] if fresh else out


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Where words, CJK characters and marks stand in a text."""
    return [m.span() for m in UNIT.finditer(text)]


def token_spans(path: str) -> Callable[[str], list[tuple[int, int]]]:
    """The same for the tokens of a tokenizer's file, without added special tokens."""
    tokenizer = _tokenizer(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).offsets


def _tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def token_counts(path: str) -> Callable[[list[str]], list[int]]:
    """How many tokens token_spans finds in each of some texts.

    A byte-level tokenizer merges within pieces of its pattern only, so a text's count is the sum of its pieces' counts,
    each of which the library's model gives once. Other tokenizers, texts with an added token's string and texts with characters
    that versions of Unicode may split otherwise go to the library whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = _tokenizer(path)
    library = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    with open(path) as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        return library
    import regex

    pieces, known, merge = regex.compile(BYTE_LEVEL).findall, {}, tokenizer.model.tokenize
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def counts(texts: list[str]) -> list[int]:
        found = [pieces(t) if PLAIN.fullmatch(t) and not any(a in t for a in added) else None for t in texts]
        every = set().union(*(p for p in found if p))
        if len(known) + len(every) > REMEMBERED:
            known.clear()
        for piece in every.difference(known):
            known[piece] = len(merge(piece.encode().decode("latin-1").translate(BYTE_CHARS)))
        rest = iter(library([t for t, p in zip(texts, found) if p is None]))
        return [next(rest) if p is None else sum(map(known.__getitem__, p)) for p in found]

    return counts


def sentence_pieces(text: str, most: int, spans: Callable[[str], list[tuple[int, int]]] = unit_spans, counts: Callable[[list[str]], list[int]] | None = None) -> list[tuple[str, int]]:
    """Sentences and lines with their sizes in units or tokens; one above `most` is cut where they begin. A size is that
    of the piece by itself, as a tokenizer may read it otherwise than in its sentence. A character is never cut. counts
    gives sizes where it is quicker than spans; then spans are only made of what is cut."""
    parts = [m.group() for m in SENTENCE.finditer(text) if m.group().strip()]
    out, todo = [], list(zip(parts, counts(parts) if counts else [None] * len(parts)))[::-1]
    while todo:
        piece, n = todo.pop()
        if n is not None and n <= most:
            out.append((piece, n))
            continue
        found = spans(piece)
        at = [0, *sorted({found[k][0] for k in range(most, len(found), most)} - {0}), len(piece)]
        if len(found) <= most or len(at) == 2:
            out.append((piece, len(found)))
        else:
            cut = [piece[a:b] for a, b in zip(at, at[1:])]
            todo += list(zip(cut, counts(cut) if counts else [None] * len(cut)))[::-1]
    return out


def chunk_tree(doc_id: Any, text: str, budgets: tuple[int, ...], overlap: int, spans: Callable[[str], list[tuple[int, int]]] = unit_spans, counts: Callable[[list[str]], list[int]] | None = None) -> list[tuple]:
    """Chunks of all levels; each holds a run of its parent's pieces, so a child's text lies within its parent's."""
    out: list[tuple] = []
    roles = ["root", *["parent"] * (len(budgets) - 2), "leaf"] if len(budgets) > 1 else ["leaf"]
    level: list[tuple[str | None, list[tuple[str, int]]]] = [(None, sentence_pieces(text or "", budgets[-1], spans, counts))]
    for depth, (budget, role) in enumerate(zip(budgets, roles)):
        below = []
        for parent, pieces in level:
            for run in pack_units(pieces, budget, overlap if budget > 2 * overlap else 0):
                body = "".join(p for p, _ in run).strip()
                name = hashlib.sha256(f"{doc_id}|{depth}|{len(below)}|{body}".encode()).hexdigest()[:32]
                out.append((name, parent, role, depth, len(below), body))
                below.append((name, run))
        level = below
    return out


def hierarchical_chunks(documents: DataFrame, text_col: str = "text", budgets: tuple[int, ...] = (2048, 512, 128), overlap: int = 50, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, chunk_id, parent_id, chunk_role, level, ordinal, text): root, parent and leaf chunks by budgets of
    tokens, where the path of a tokenizer's file is given (it must exist on executors), else of units (words, CJK
    characters, marks). Sentences are packed whole; one above the smallest budget is cut where a token begins. Ids are
    digests, so equal documents give equal chunks wherever they run."""
    rows = documents.select("doc_id", F.col("doc_id").cast("string").alias("name"), F.col(text_col).alias("text"))

    def start() -> Callable:
        spans, counts = (token_spans(tokenizer), token_counts(tokenizer)) if tokenizer else (unit_spans, None)
        return lambda name, text: chunk_tree(name, text, budgets, overlap, spans, counts)

    return per_document(rows, ["name", "text"], None, CHUNK, start)


def table_parts(text: str, most: int) -> list[tuple]:
    """(part, parts, Markdown, headers, rows) of a Markdown table in parts of at most `most` characters, rows kept
    whole, the header in each; a table that needs no cut, or isn't one, is a part as it stands, without headers."""
    whole = [(0, 1, text, None, None)]
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in (text or "").splitlines() if line.strip().startswith("|") and line.strip().endswith("|")]
    rows = [r for r in rows if any(r) and not all(re.fullmatch(r":?-{3,}:?", c) for c in r)]
    if len((text or "").strip()) <= most or len(rows) <= 2:
        return whole
    head, body = rows[0], rows[1:]
    fixed = len(markdown_rows([head]))
    parts: list[list[list[str]]] = []
    size = most + 1
    for row in body:
        cost = len(markdown_rows([row]).split("\n")[0]) + 1
        if size + cost > most:
            parts.append([])
            size = fixed
        parts[-1].append(row)
        size += cost
    return whole if len(parts) == 1 else [(k, len(parts), markdown_rows([head, *p]), head, len(p)) for k, p in enumerate(parts)]


def split_large_tables(blocks: DataFrame, most_chars: int = 3000) -> DataFrame:
    """(doc_id, block_index, part_index, part_count, text, table_id, headers, row_count): long tables in parts, all other
    blocks as one. A part keeps its table's id and headers and has its own number of rows; what isn't cut has none of
    them beside an id."""
    table = F.coalesce(F.col("extra")["table_id"], F.lit("")) if "extra" in blocks.columns else F.lit("")
    rows = blocks.select("doc_id", F.col("block_index").cast("int").alias("block_index"), "block_type", "text", table.alias("table_id"))
    cut = lambda i, kind, text, name: [(i, k, n, part, name.strip(), heads, size) for k, n, part, heads, size in (table_parts(text, most_chars) if kind == "table" else [(0, 1, text, None, None)])]
    return per_document(rows, ["block_index", "block_type", "text", "table_id"], cut, "block_index int, part_index int, part_count int, text string, table_id string, headers array<string>, row_count int")

"""Splitting of documents into overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Characters of chunks that a worker gathers before it sends them on.
PARCEL = 1 << 20
CHUNK = "chunk_index int, start int, `end` int, cut_type string, is_last boolean, content string"


@dataclass(frozen=True)
class Chunk:
    """One piece of a text; cut_type is None on the last."""

    index: int
    start: int
    end: int
    cut_type: str | None
    is_last: bool
    text: str
    metadata: dict | None = None

    def __repr__(self) -> str:
        return f"Chunk(index={self.index}, text='{self.text[:50]}{'...' if len(self.text) > 50 else ''}')"


class TextSplitter(Protocol):
    """Anything that cuts a text into chunks, in order."""

    def split_text(self, text: str | None) -> Iterator[Chunk]: ...


@dataclass(frozen=True)
class WindowSplitter:
    """Chunks of about chunk_size characters, each starting `overlap` before the end of the one before. A cut goes just
    behind the last newline at most `threshold` away from its place, if there is one."""

    chunk_size: int = 1000
    overlap: int = 200
    threshold: int = 100

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be at least 0 and less than chunk_size")
        if self.threshold < 0:
            raise ValueError("threshold must not be negative")

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        size, at, index = len(text or ""), 0, 0
        while at < size:
            goal = at + self.chunk_size
            if goal >= size:
                yield Chunk(index, at, size, None, True, text[at:])
                return
            newline = text.rfind("\n", max(at, goal - self.threshold), min(size, goal + self.threshold))
            cut, kind = (goal, "hard") if newline < 0 else (newline + 1, "newline")
            yield Chunk(index, at, cut, kind, False, text[at:cut])
            at, index = max(at + 1, cut - self.overlap), index + 1


@dataclass(frozen=True)
class ParagraphSplitter:
    """Paragraphs between blank lines of more than `least` characters."""

    least: int = 100
    pattern: str = r"\n\n"

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        edges = [0, *(x for m in re.finditer(self.pattern, text or "") for x in m.span()), len(text or "")]
        spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > self.least]
        for i, (a, b) in enumerate(spans):
            yield Chunk(i, a, b, "paragraph" if i < len(spans) - 1 else None, i == len(spans) - 1, text[a:b])


@dataclass(frozen=True)
class SentenceSplitter:
    """Sentences, packed whole into chunks of at most chunk_size characters where they fit."""

    chunk_size: int = 1000

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        text = text or ""
        ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s)\s+", text)]
        at = index = last = 0
        for end in [*ends, len(text)]:
            if end - at > self.chunk_size and last > at:
                yield Chunk(index, at, last, "sentence", False, text[at:last])
                at, index = last, index + 1
            last = end
        if at < len(text):
            yield Chunk(index, at, len(text), None, True, text[at:])


@dataclass(frozen=True)
class MarkdownSplitter:
    """Sections under headings, code blocks kept whole; sections over chunk_size are cut by windows. A chunk's cut_type
    is its path of headings."""

    chunk_size: int = 1000

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        text, path, sections, fenced, at = text or "", [], [], False, 0
        for m in re.finditer(r"[^\n]*\n?", text):
            line = m[0]
            if line.startswith("```"):
                fenced = not fenced
            head = None if fenced else re.match(r"(#{1,6})\s+(.*)", line)
            if head:
                sections.append((at, m.start(), " > ".join(t for _, t in path)))
                at = m.start()
                path = [p for p in path if p[0] < len(head[1])] + [(len(head[1]), head[2].strip())]
        sections.append((at, len(text), " > ".join(t for _, t in path)))
        pieces = []
        for a, b, crumbs in sections:
            if b - a <= self.chunk_size or "```" in text[a:b]:
                pieces += [(a, b, crumbs)] if text[a:b].strip() else []
            else:
                pieces += [(a + c.start, a + c.end, crumbs) for c in WindowSplitter(self.chunk_size, 0, self.chunk_size // 10).split_text(text[a:b])]
        for i, (a, b, crumbs) in enumerate(pieces):
            yield Chunk(i, a, b, crumbs, i == len(pieces) - 1, text[a:b])


@dataclass(frozen=True)
class HierarchicalSplitter:
    """Small chunks to search, each inside a large one to show. A chunk's cut_type is `start-end` of its large one."""

    parent: TextSplitter = WindowSplitter(2000, 0, 200)
    child: TextSplitter = WindowSplitter(400, 50, 40)

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        made = [(p, c) for p in self.parent.split_text(text) for c in self.child.split_text(p.text)]
        for i, (p, c) in enumerate(made):
            yield Chunk(i, p.start + c.start, p.start + c.end, f"{p.start}-{p.end}", i == len(made) - 1, c.text)


def with_parents(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of a HierarchicalSplitter and parent_content, the text of the large chunk that each is in."""
    edge = F.split("cut_type", "-")
    start, end = edge[0].cast("int"), edge[1].cast("int")
    return chunks.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col).withColumn("parent_content", F.substring(F.col("_text"), start + 1, end - start)).drop("_text")


#: Characters of the pieces that a long text is looked at in; a character's place in a string is found by counting.
PIECE, STEPS = 1 << 12, 64


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def window_chunks(text: Column | str, splitter: WindowSplitter | None = None) -> Column:
    """The chunks that a WindowSplitter makes, as an array of structs in their order: folds without Python.

    A fold's state is the next chunk's start and the spans so far. Its steps are bounded by the text's length over the
    least advance. As each step copies its state, STEPS spans are folded at a time and then put behind the others; texts
    are looked at in pieces, and chunks are cut out at the end, so a long text costs in proportion to its length.
    """
    s = splitter or WindowSplitter()
    piece, advance = max(PIECE, s.chunk_size + s.threshold), max(1, s.chunk_size - s.threshold - s.overlap)
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    span = "array<struct<start:int,`end`:int,newline:boolean>>"

    def part(pieces: Column, a: Column, b: Column) -> Column:
        """text[a:b] of at most a piece's length."""
        first = F.shiftright(a, PIECE.bit_length() - 1) if piece == PIECE else F.floor(a / piece).cast("int")
        at, here = a - first * piece, F.element_at(pieces, first + 1)
        across = F.concat(F.substring(here, at + 1, F.lit(piece)), F.coalesce(F.try_element_at(pieces, first + 2), F.lit("")))
        return F.when(at + (b - a) <= piece, F.substring(here, at + 1, b - a)).otherwise(F.substring(across, F.lit(1), b - a))

    def step(state: Column, pieces: Column, n: Column) -> Column:
        at = state["at"]
        low, high = F.greatest(at, at + (s.chunk_size - s.threshold)), F.least(n, at + (s.chunk_size + s.threshold))

        def cut_at(back: Column) -> Column:
            cut = F.when(back > 0, high - back + 1).otherwise(at + s.chunk_size)
            made = F.struct(at.alias("start"), cut.alias("end"), (back > 0).alias("newline"))
            return F.struct(F.greatest(at + 1, cut - s.overlap).alias("at"), F.concat(state["made"], F.array(made)).alias("made"))

        rest = F.struct(n.alias("at"), F.concat(state["made"], F.array(F.struct(at.alias("start"), n.alias("end"), F.lit(None).cast("boolean").alias("newline")))).alias("made"))
        cut = _let(F.instr(F.reverse(part(pieces, low, high)), "\n"), cut_at)
        return F.when(at >= n, state).when(at + s.chunk_size >= n, rest).otherwise(cut)

    def fold(held: Column) -> Column:
        n, pieces = held["n"], held["pieces"]
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(span).alias("made"))
        steps = F.floor(n / advance).cast("int") + 1
        some = lambda at: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(STEPS), steps)), begin(at), lambda state, _: step(state, pieces, n))
        more = lambda state, _: _let(some(state["at"]), lambda x: F.struct(x["at"].alias("at"), F.concat(state["made"], x["made"]).alias("made")))
        spans = F.when(steps <= STEPS, some(F.lit(0))["made"]).otherwise(F.aggregate(F.sequence(F.lit(0), F.floor(steps / STEPS).cast("int")), begin(F.lit(0)), more)["made"])

        def whole(x: Column) -> Column:
            last = x["newline"].isNull()
            cut_type = F.when(last, F.lit(None)).when(x["newline"], "newline").otherwise("hard")
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), cut_type.alias("cut_type"), last.alias("is_last"), part(pieces, x["start"], x["end"]).alias("content"))

        return F.transform(spans, whole)

    def cut(whole: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.length(whole) / size).cast("int")), lambda i: F.substring(whole, i * size + 1, F.lit(size)))

    # pieces of pieces: each is found by counting from the start of what it is cut from
    pieces = F.when(F.length(text) <= piece, F.array(text)).otherwise(F.flatten(F.transform(cut(text, 32 * piece), lambda x: F.slice(cut(x, piece), 1, 32))))
    return _let(F.struct(F.length(text).alias("n"), pieces.alias("pieces")), fold)


def parcels(made: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Chunks by lists of PARCEL characters in all, or one chunk beyond them; the content is the seventh field."""
    part, size = [], 0
    for row in made:
        part.append(row)
        size += len(row[6]) + 100
        if size >= PARCEL:
            yield part
            part, size = [], 0
    if part:
        yield part


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", splitter: TextSplitter | None = None, native: bool = False) -> DataFrame:
    """id_col and the columns of CHUNK: a row per chunk, produced where its document is; no shuffle. A worker holds the
    Arrow batch of texts that it was sent, one text of it as a string, and PARCEL characters of chunks.

    A splitter with a METADATA type has a column `metadata` too. native: windows are cut by `window_chunks`, without
    Python workers; on one machine its interpreted folds take about twice the time of a worker's loop.
    """
    splitter = splitter or WindowSplitter()
    if native:
        if type(splitter) is not WindowSplitter:
            raise ValueError("only windows are cut without Python")
        cut = docs.where(F.length(text_col) > 0).select(id_col, F.posexplode(window_chunks(F.col(text_col), splitter)).alias("chunk_index", "_c"))
        return cut.select(id_col, "chunk_index", *[F.col(f"_c.{c}").alias(c) for c in ("start", "end", "cut_type", "is_last", "content")])
    kind, more = getattr(splitter, "METADATA", None), ["metadata"] if hasattr(splitter, "METADATA") else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = ["_id", "chunk_index", "start", "end", "cut_type", "is_last", "content", *more]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), *([to_arrow_type(DataType.fromDDL(kind))] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            # one text at a time leaves the batch
            made = ((i.as_py(), c.index, c.start, c.end, c.cut_type, c.is_last, c.text, *([c.metadata] if more else [])) for i, t in zip(x["_id"], x["_text"], strict=True) for c in splitter.split_text(t.as_py()))
            for part in parcels(made):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part, strict=True), [x.schema.field("_id").type, *types], strict=True)], names)

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, {CHUNK}" + (f", metadata {kind}" if more else "")
    return rows.where("_text is not null").mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def statistics(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, chunks, and averages, 0 where there are no documents."""
    d = docs.agg(F.count("*").alias("n_documents"), F.sum(F.length(text_col)).alias("chars"))
    c = chunks.agg(F.count("*").alias("n_chunks"))
    some = lambda v: F.when(F.col("n_documents") > 0, v).otherwise(F.lit(0.0))
    return d.join(F.broadcast(c)).select(
        "n_documents", "n_chunks", F.round(some(F.col("chars") / F.col("n_documents")), 6).alias("avg_chars"), F.round(some(F.col("n_chunks") / F.col("n_documents")), 6).alias("avg_chunks")
    )


def listing(chunks: DataFrame, id_col: str = "doc_id", first: int = 3, width: int = 80) -> DataFrame:
    """The first chunks of each document with previews. Chunks are numbered from 0, so no window is needed."""
    from tidewater.functions.text import preview

    return chunks.where(F.col("chunk_index") < first).select(id_col, "chunk_index", preview("content", width).alias("preview"))

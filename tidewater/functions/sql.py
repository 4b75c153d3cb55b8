"""Splitters and embedders as functions of SQL.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL split_text(text, 'window', 1000) c")
    spark.sql("SELECT * FROM embed_rows(TABLE(notes), 'content')")
    spark.sql("SELECT embed_text(title) FROM notes")

`split_text(text, kind, chunk_size)` is a table function whose columns depend on the kind of splitter, which must be a
constant: those of a chunk, and `metadata` where the splitter has some. `embed_rows(TABLE(...), column)` gives the table
back with a column `embedding`. Both check their arguments when a query is analysed, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewater.operators.chunking import CHUNK, ParagraphSplitter, SentenceSplitter, TextSplitter, WindowSplitter
from tidewater.operators.code import CodeSplitter
from tidewater.operators.embedding import Embedder, HashingEmbedder, embed_function, wrapped
from tidewater.operators.markdown import MarkdownBlockSplitter

#: What makes a splitter of each kind from a chunk size; None: the kind's own.
KINDS: dict[str, Callable[[int | None], TextSplitter]] = {
    "window": lambda n: WindowSplitter() if n is None else WindowSplitter(n, n // 5, n // 10),
    "sentence": lambda n: SentenceSplitter() if n is None else SentenceSplitter(n),
    "paragraph": lambda n: ParagraphSplitter() if n is None else ParagraphSplitter(n),
    "markdown": lambda n: MarkdownBlockSplitter() if n is None else MarkdownBlockSplitter(n, n // 4),
    "code": lambda n: CodeSplitter() if n is None else CodeSplitter(n),
}


def _constant(argument: AnalyzeArgument | None, kind: type, name: str):
    if argument is None:
        return None
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.dataType, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__.removesuffix('Type').lower()}")
    return argument.value


def _split_text(schemas: dict[str, StructType]) -> type:
    class SplitText:
        """The chunks of a text, one row each; none for a null text."""

        def __init__(self):
            self.splitter: tuple | None = None

        @staticmethod
        def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None, chunk_size: AnalyzeArgument | None = None) -> AnalyzeResult:
            if text.isTable or not isinstance(text.dataType, StringType):
                raise ValueError("split_text takes a string")
            name = _constant(kind, StringType, "kind") or "window"
            if name not in KINDS:
                raise ValueError(f"unknown kind of splitter: {name}; known: {', '.join(KINDS)}")
            KINDS[name](_constant(chunk_size, IntegerType, "chunk_size"))  # raises what the splitter raises
            return AnalyzeResult(schema=schemas[name])

        def eval(self, text: str | None, kind: str | None = None, chunk_size: int | None = None) -> Iterator[tuple]:
            if self.splitter is None or self.splitter[0] != (kind, chunk_size):
                self.splitter = (kind, chunk_size), KINDS[kind or "window"](chunk_size)
            more = hasattr(self.splitter[1], "METADATA")
            for c in self.splitter[1].split_text(text):
                yield (c.index, c.start, c.end, c.cut_type, c.is_last, c.text, *([c.metadata] if more else []))

    return SplitText


def _embed_rows(embedder: Embedder, batch: int) -> type:
    class EmbedRows:
        """A table's rows with a vector of one of their columns, embedded `batch` at a time; null and blank texts have none."""

        def __init__(self):
            self.held: list[tuple[Row, str | None]] = []

        @staticmethod
        def analyze(rows: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("embed_rows takes a TABLE")
            name = _constant(column, StringType, "column")
            if name not in rows.dataType.names or not isinstance(rows.dataType[name].dataType, StringType):
                raise ValueError(f"no string column: {name}")
            if "embedding" in rows.dataType.names:
                raise ValueError("the table already has a column embedding")
            return AnalyzeResult(schema=StructType([*rows.dataType.fields]).add("embedding", ArrayType(FloatType())))

        def eval(self, rows: Row, column: str) -> Iterator[tuple]:
            self.held.append((rows, rows[column]))
            if len(self.held) >= batch:
                yield from self.flushed()

        def terminate(self) -> Iterator[tuple]:
            yield from self.flushed()

        def flushed(self) -> Iterator[tuple]:
            texts = [t for _, t in self.held if t and t.strip()]
            vectors = iter(wrapped(embedder, texts, "document") if texts else ())
            for row, text in self.held:
                yield (*row, next(vectors).tolist() if text and text.strip() else None)
            self.held = []

    return EmbedRows


def register(spark: SparkSession, embedder: Embedder | None = None, batch: int = 256) -> None:
    """Makes split_text, embed_rows and embed_text known to the session's SQL."""
    embedder = embedder or HashingEmbedder()
    # a worker that analyses a call can't read type strings
    more = lambda s: f", metadata {s.METADATA}" if hasattr(s, "METADATA") else ""
    schemas = {kind: StructType.fromDDL(CHUNK + more(make(None))) for kind, make in KINDS.items()}
    spark.udtf.register("split_text", F.udtf(_split_text(schemas), useArrow=True))
    spark.udtf.register("embed_rows", F.udtf(_embed_rows(embedder, batch)))
    spark.udf.register("embed_text", embed_function(embedder))

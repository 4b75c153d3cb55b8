"""Source code by its syntax tree: functions, classes and the statements between them, with the imports they need."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from tidewater.operators.chunking import Chunk, WindowSplitter

METADATA = "struct<name:string,kind:string,imports:string>"
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


@dataclass(frozen=True)
class Unit:
    """Lines [first, last) that belong together: a function, a class, a method, or statements."""

    first: int
    last: int
    kind: str
    name: str | None
    node: ast.AST | None = None


def _first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1


def _units(body: list[ast.stmt], first: int, last: int, prefix: str = "") -> Iterator[Unit]:
    """The statements of a body as units that cover the lines [first, last). What stands before a statement (comments,
    blank lines) goes with it; what stands behind the last one goes with that."""
    at, plain = first, None  # plain: statements in a row that define nothing
    for i, node in enumerate(body):
        end = last if i == len(body) - 1 else node.end_lineno
        if i < len(body) - 1 and _first_line(body[i + 1]) < end:  # statements that share a line
            end = at
        if end <= at:
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, _DEFINITIONS) else "statements"
        if kind == "statements":
            plain = Unit(plain.first if plain else at, end, kind, prefix.rstrip(".") or None)
        else:
            if plain:
                yield plain
                plain = None
            yield Unit(at, end, kind, prefix + node.name, node)
        at = end
    if plain:
        yield plain


@dataclass(frozen=True)
class CodeSplitter:
    """Python source cut between functions, classes and the statements around them.

    A class over chunk_size is cut into its head and its members; any other unit over chunk_size is cut by windows at
    newlines. A chunk's cut_type is the name of what it holds (`C.g`), null for statements of the module. Every chunk
    carries the module's imports in front of its text, but for those that it holds itself; start and end are of the
    piece alone. metadata: name, kind (function, class, statements, text), imports.

    Source that doesn't parse is cut by windows at newlines as kind `text`, without imports. An empty text has no chunks.
    """

    chunk_size: int = 1000
    METADATA = METADATA

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")

    def _split(self, u: Unit, at: list[int]) -> Iterator[Unit]:
        body = getattr(u.node, "body", [])
        if u.kind != "class" or at[u.last] - at[u.first] <= self.chunk_size or _first_line(body[0]) <= u.node.lineno - 1:
            yield u
            return
        inside = list(_units(body, _first_line(body[0]), u.last, f"{u.name}."))
        head = Unit(u.first, inside[0].first if inside[0].kind != "statements" else inside[0].last, "class", u.name)
        yield head
        for x in inside[inside[0].kind == "statements" :]:
            yield from self._split(x, at)

    def pieces(self, text: str) -> Iterator[tuple[int, int, str, str | None, str]]:
        """(start, end, kind, name, imports)."""
        windows = WindowSplitter(self.chunk_size, 0, self.chunk_size // 2)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            tree = None
        if tree is None or not tree.body:
            yield from ((c.start, c.end, "text", None, "") for c in windows.split_text(text))
            return
        lines = _lines(text)
        at = [0, *accumulate(map(len, lines))]
        found = [(n.lineno - 1, n.end_lineno) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
        for top in _units(tree.body, 0, len(lines)):
            for u in self._split(top, at):
                start, end = at[u.first], at[u.last]
                spans = [(start, end)] if end - start <= self.chunk_size else [(start + c.start, start + c.end) for c in windows.split_text(text[start:end])]
                for a, b in spans:
                    yield a, b, u.kind, u.name, "".join(text[at[x] : at[y]] for x, y in found if not a <= at[x] < b)

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        text, index, held = text or "", 0, None
        for piece in self.pieces(text):
            if held:
                yield self._chunk(text, index, False, *held)
                index += 1
            held = piece
        if held:
            yield self._chunk(text, index, True, *held)

    def _chunk(self, text: str, index: int, last: bool, start: int, end: int, kind: str, name: str | None, imports: str) -> Chunk:
        head = imports if not imports or imports.endswith("\n") else imports + "\n"
        return Chunk(index, start, end, name, last, head + text[start:end], {"name": name, "kind": kind, "imports": imports})


def _lines(text: str) -> list[str]:
    """Lines as the parser counts them: other separators that splitlines() knows are no ends of lines in source."""
    return re.findall(r"[^\r\n]*(?:\r\n?|\n)|[^\r\n]+", text)

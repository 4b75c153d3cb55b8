"""Markdown by blocks: a line scanner with a stack of containers, sections of headings, packing and a fallback by windows.

`blocks` reads lines once and keeps the containers (quotes, list items) that are open, so a fence inside a list item is
code and ends with it, and `# x` inside a fence is no heading. Blocks under a heading are segments with the path of
headings above them. Small neighbours are packed into one chunk; code is never packed with prose, so a chunk is code or
is not; what is larger than a chunk is cut by windows whose pieces all keep the metadata.

Every character of a chunk is the document's, from `start` to `end`; blank lines between chunks belong to none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from tidewater.operators.chunking import Chunk, WindowSplitter

METADATA = "struct<headers:array<string>,assets:array<struct<src:string,alt:string>>,is_code:boolean,language:string>"

_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_ATX = re.compile(r"(#{1,6})(?= |$)")
_RULE = re.compile(r"(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_UNDERLINE = re.compile(r"(?:=+|-+) *$")
_ITEM = re.compile(r"(?:[-+*]|\d{1,9}[.)])(?= |$)")
_DELIMITERS = re.compile(r"\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
_RAW = re.compile(r"<(script|pre|style|textarea)(?=[\s>]|$)|<!--", re.IGNORECASE)
_IMAGE = re.compile(r"!\[([^\[\]]*)\]\(\s*<?([^()\s<>]+)>?[^()]*\)")


@dataclass(frozen=True)
class Block:
    """One block: heading, paragraph, table, code, raw or rule. depth: how many containers it is in."""

    kind: str
    start: int
    end: int
    depth: int = 0
    level: int = 0
    title: str = ""
    language: str | None = None


@dataclass(frozen=True)
class Segment:
    """Blocks under a path of headings; starts with the headings that stand directly before it."""

    start: int
    end: int
    path: tuple[str, ...]
    is_code: bool = False
    language: str | None = None


def _pad(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def _heading(rest: str) -> str:
    """A heading's text without closing marks."""
    title = rest.strip(" ")
    bare = title.rstrip("#")
    return bare.rstrip(" ") if bare != title and (not bare or bare[-1] == " ") else title


def _continues(line: str, stack: list[int]) -> tuple[int, str]:
    """How many of the open containers a line goes on in, and what is left of it. 0 in the stack is a quote, else the
    width of a list item's indent."""
    for kept, width in enumerate(stack):
        pad = _pad(line)
        if width == 0:
            if pad > 3 or line[pad : pad + 1] != ">":
                return kept, line
            line = line[pad + 1 :].removeprefix(" ")
        elif line.strip(" "):
            if pad < width:
                return kept, line
            line = line[width:]
    return len(stack), line


def _opens(line: str, in_paragraph: bool) -> tuple[list[int], str]:
    """Containers that a line opens, and what is left of it."""
    new: list[int] = []
    while (pad := _pad(line)) < 4:
        body = line[pad:]
        if body[:1] == ">":
            new.append(0)
            line = body[1:].removeprefix(" ")
            continue
        item = _ITEM.match(body)
        if not item or _RULE.match(body):
            break
        behind = body[item.end() :]
        if in_paragraph and not new and (not behind.strip(" ") or (item[0][0].isdigit() and item[0][:-1] != "1")):
            break  # no such item interrupts a paragraph
        gap = _pad(behind)
        gap = 1 if gap > 4 or not behind.strip(" ") else gap
        new.append(pad + item.end() + gap)
        line = behind[gap:]
    return new, line


def blocks(text: str) -> Iterator[Block]:
    """The blocks of a text in order."""
    stack: list[int] = []
    now: Block | None = None
    ends = ""  # what ends open code or raw text: a fence, "indent", or a tag
    lines, at = 0, 0  # lines of the open block
    while at < len(text):
        stop = text.find("\n", at) + 1 or len(text)
        line = text[at:stop].rstrip("\r\n").expandtabs(4)
        kept, rest = _continues(line, stack)
        body, inside = rest.lstrip(" "), kept == len(stack)
        if now and now.kind in ("code", "raw") and ends != "indent" and inside:
            now = replace(now, end=stop)
            closed = ends in rest.lower() if now.kind == "raw" else _pad(rest) < 4 and body.rstrip(" ").strip(ends[0]) == "" and len(body.rstrip(" ")) >= len(ends)
            if closed:
                yield now
                now = None
            at = stop
            continue
        paragraph = now is not None and now.kind == "paragraph"
        if paragraph and inside and _pad(rest) < 4 and _UNDERLINE.match(body):
            title = " ".join(x.strip() for x in text[now.start : at].split("\n")).strip()
            yield replace(now, kind="heading", end=stop, level=1 if body[0] == "=" else 2, title=title)
            now, at = None, stop
            continue
        new, rest = _opens(rest, paragraph and inside)
        body, pad = rest.lstrip(" "), _pad(rest)
        fence, atx = _FENCE.match(body) if pad < 4 else None, _ATX.match(body) if pad < 4 else None
        rule, raw = pad < 4 and _RULE.match(body), _RAW.match(body) if pad < 4 else None
        plain = bool(body) and not (fence or atx or rule or raw)
        if paragraph and plain and not new:  # also lazily, without the containers' marks
            table = inside and lines == 1 and _DELIMITERS.match(body) and "|" in body + text[now.start : at]
            now, lines, at = replace(now, end=stop, kind="table" if table else "paragraph"), lines + 1, stop
            continue
        goes_on = now and inside and not new
        if goes_on and now.kind == "table" and plain or goes_on and ends == "indent" and now.kind == "code" and pad >= 4 and body:
            now, at = replace(now, end=stop), stop
            continue
        if now and not (goes_on and now.kind == "code" and not body):  # blank lines inside indented code
            yield now
            now = None
        stack = stack[:kept] + new
        block = Block("paragraph", at, stop, len(stack))
        if pad >= 4 and body:
            now, ends = replace(block, kind="code"), "indent"
        elif fence:
            now, ends = replace(block, kind="code", language=((fence[2] or fence[4] or "").split() or [None])[0]), fence[1] or fence[3]
        elif atx:
            yield replace(block, kind="heading", level=len(atx[1]), title=_heading(body[atx.end() :]))
        elif rule:
            yield replace(block, kind="rule")
        elif raw:
            ends = f"</{raw[1].lower()}>" if raw[1] else "-->"
            if ends in body.lower():
                yield replace(block, kind="raw")
            else:
                now = replace(block, kind="raw")
        elif body:
            now, lines = block, 1
        at = stop
    if now:
        yield now


def segments(text: str) -> Iterator[Segment]:
    """Blocks with the headings over them. Headings inside containers are text."""
    path: list[tuple[int, str]] = []
    begun = last = None
    for b in blocks(text):
        last = b
        if b.kind == "heading" and not b.depth:
            path = [p for p in path if p[0] < b.level] + [(b.level, b.title)]
            begun = b.start if begun is None else begun
            continue
        yield Segment(b.start if begun is None else begun, b.end, tuple(t for _, t in path), b.kind == "code", b.language)
        begun = None
    if begun is not None:
        yield Segment(begun, last.end, tuple(t for _, t in path))


@dataclass(frozen=True)
class MarkdownBlockSplitter:
    """Chunks of whole blocks of at most chunk_size characters.

    Neighbours under one heading are packed as far as they fit. A chunk smaller than `least` also takes the next section;
    its headers are those that its sections share. Larger blocks are cut at newlines near chunk_size. A chunk's cut_type
    is its path; metadata: headers, images (src, alt), is_code, language.
    """

    chunk_size: int = 1000
    least: int = 250
    METADATA = METADATA

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if self.least < 0:
            raise ValueError("least must not be negative")

    def packed(self, text: str) -> Iterator[Segment]:
        now: Segment | None = None
        for s in segments(text):
            fits = now and not now.is_code and not s.is_code and s.end - now.start <= self.chunk_size
            if fits and (s.path == now.path or now.end - now.start < self.least):
                shared = next((i for i, (a, b) in enumerate(zip(now.path, s.path, strict=False)) if a != b), min(len(now.path), len(s.path)))
                now = replace(now, end=s.end, path=now.path[:shared])
                continue
            if now:
                yield now
            now = s
        if now:
            yield now

    def pieces(self, text: str) -> Iterator[tuple[int, int, Segment]]:
        for s in self.packed(text):
            if s.end - s.start <= self.chunk_size:
                yield s.start, s.end, s
                continue
            # code has newlines everywhere, so a cut may look for one further away
            windows = WindowSplitter(self.chunk_size, 0, self.chunk_size // (2 if s.is_code else 10))
            yield from ((s.start + c.start, s.start + c.end, s) for c in windows.split_text(text[s.start : s.end]))

    def split_text(self, text: str | None) -> Iterator[Chunk]:
        text, index, held = text or "", 0, None
        for piece in self.pieces(text):
            if held:
                yield self._chunk(text, index, False, *held)
                index += 1
            held = piece
        if held:
            yield self._chunk(text, index, True, *held)

    def _chunk(self, text: str, index: int, last: bool, start: int, end: int, s: Segment) -> Chunk:
        # all pieces of a block have its images
        found = [] if s.is_code else [{"src": m[2], "alt": m[1]} for m in _IMAGE.finditer(text, s.start, s.end)]
        metadata = {"headers": list(s.path), "assets": found, "is_code": s.is_code, "language": s.language}
        return Chunk(index, start, end, " > ".join(s.path), last, text[start:end], metadata)

"""Chat formatting with typed content parts.

A turn's content is a text or a list of typed parts. A visitor flattens the parts into text with ordered placeholders,
one for each image, audio clip or document, and records each attachment's reference and the number of tokens that its
placeholder expands to. The template marks turns; control strings inside texts are broken by an escape that
`unescape` reverses. A turn is formatted by itself, so no conversation is gathered: a conversation's output is its
turns' segments in order, and readers stream over them.

Defined results: a null text or content is empty, a null role is an empty role; turns are ordered by turn (nulls
first), then role and text; repeated rows are repeated turns; rows with a null conv_id form one conversation; unknown
part types raise ValueError; text parts that touch are one text; further columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that mean something to this template or to common ones. Each starts with its only "<" or "[".
CONTROLS = (TURN, BODY, END, *PLACEHOLDERS.values(), "<s>", "</s>", "<unk>", "<pad>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes, then puts one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1], text)


@dataclass
class Flattened:
    """What the visitor has seen: pieces of output, attachments in order, expanded tokens of each."""

    pieces: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # texts since the last attachment, not escaped yet
    attachments: list[tuple[str, str]] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)

    def close(self) -> None:
        """Texts that touch are escaped as one, since a control string may run over several of them."""
        self.pieces.append(escape("".join(self.text)))
        self.text = []


@dataclass(frozen=True)
class PartVisitor:
    """Visits typed parts. A placeholder expands to a token for each image patch, audio frame or document page block."""

    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256

    def visit(self, part: dict, out: Flattened) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", *PLACEHOLDERS):
            raise ValueError(f"unknown part type: {kind}")
        getattr(self, f"visit_{kind}")(part, out)

    def visit_text(self, part: dict, out: Flattened) -> None:
        out.text.append(part.get("text") or "")

    def attach(self, kind: str, part: dict, tokens: float, out: Flattened) -> None:
        out.close()
        out.pieces.append(PLACEHOLDERS[kind])
        out.attachments.append((kind, part.get("ref") or ""))
        out.tokens.append(max(1, math.ceil(tokens)))

    def visit_image(self, part: dict, out: Flattened) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        self.attach("image", part, math.ceil(width / self.patch) * math.ceil(height / self.patch), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self.attach("audio", part, (part.get("seconds") or 0.0) * self.audio_tokens_per_second, out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.tokens_per_page, out)


def format_turn(role: str | None, content: str | list[dict] | None, visitor: PartVisitor | None = None) -> tuple[str, int, int, Flattened]:
    """The segment, the span of it under the loss mask (empty unless the role is assistant), and what was flattened."""
    out = Flattened()
    for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
        (visitor or PartVisitor()).visit(part, out)
    out.close()
    head, body = TURN + escape(role or "") + BODY, "".join(out.pieces)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0), out


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def parsed(segment: str) -> tuple[str, str]:
    """Role and text read back from a segment; placeholders stay."""
    role, _, body = segment[len(TURN) : -len(END)].partition(BODY)
    return unescape(role), unescape(body)


def format_turns(turns: DataFrame, content_col: str = "text") -> DataFrame:
    """conv_id, turn, role, segment, plain (the text read back), loss_start, loss_end, attachments, expanded_tokens: one row per turn.

    content_col: a string, or an array of PART.
    """
    typed = not turns.schema[content_col].dataType.simpleString() == "string"
    # integers next to nulls would become floats in pandas
    picked = turns.select(*[F.col(k).cast("string").alias(k) for k in ("conv_id", "turn")], "role", F.col(content_col).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            content = x["content"].map(lambda c: None if c is None else [dict(p) for p in c]) if typed else x["content"]
            made = [format_turn(r, c) for r, c in zip(x["role"], content, strict=True)]
            yield x[["conv_id", "turn", "role"]].assign(
                segment=[m[0] for m in made],
                plain=[parsed(m[0])[1] for m in made],
                loss_start=[m[1] for m in made],
                loss_end=[m[2] for m in made],
                attachments=[[{"kind": k, "ref": r} for k, r in m[3].attachments] for m in made],
                expanded_tokens=[m[3].tokens for m in made],
            )

    out = picked.mapInPandas(run, "conv_id string, turn string, role string, segment string, plain string, loss_start int, loss_end int, attachments array<struct<kind:string,ref:string>>, expanded_tokens array<int>")
    return out.withColumns({k: F.col(k).cast(turns.schema[k].dataType) for k in ("conv_id", "turn")})


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its output says when read back: see the query's columns.

    Turns are sorted within partitions and streamed through running hashes: a long conversation takes no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None

        def row(s: list) -> dict:
            return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        for x in batches:
            done = []
            for conv_id, segment, start, end in zip(x["conv_id"], x["segment"], x["loss_start"], x["loss_end"], strict=True):
                if state is None or state[0] != conv_id:
                    if state is not None:
                        done.append(row(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(segment)
                loss = unescape(segment[start:end])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(segment)
            if done:
                yield pd.DataFrame(done)
        if state is not None:
            yield pd.DataFrame([row(state)])

    picked = formatted.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "plain", "segment", "loss_start", "loss_end")
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "plain")
    streamed = dealt.select(F.col("conv_id").cast("string").alias("conv_id"), "segment", "loss_start", "loss_end")
    out = streamed.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(formatted.schema["conv_id"].dataType))


_ESCAPED = " + ".join(f"(length(%s) - length(replace(%s, '{c}', ''))) // {len(c)}" for c in CONTROLS)
_LENGTH = "length(%s) + length(%s) - length(replace(%s, chr(92), '')) + " + _ESCAPED


def _sql_length(x: str) -> str:
    return _LENGTH.replace("%s", x)


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN + BODY + END)} + {_sql_length("role")} + {_sql_length("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

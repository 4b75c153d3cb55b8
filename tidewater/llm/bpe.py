"""Byte-level BPE by overlapping chunks.

A long text is cut into overlapping chunks, which are pre-tokenised in parallel. A chunk's first pre-tokens may start
in the middle of one, but as soon as a boundary of its own is also a reliable boundary of the chunk before, both agree
from there on: matching looks ahead only. The text is stitched at those seams and the pieces between them are encoded
in parallel. Where an overlap has no common boundary (one very long pre-token), the text is encoded in one piece.
Decoding concatenates the bytes of the ids. Short texts are a single chunk.

Defined results: a null text is empty; an empty text has no ids; special tokens are ordinary text; rows with the same
id and text give equal rows; further columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, texts_of, typed_id

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A boundary this near to a chunk's end isn't relied on: a match looks ahead two characters at most.
MARGIN = 8


@functools.cache
def codec(path: str) -> tiktoken.Encoding:
    """Loaded once in each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def tables(path: str) -> tuple[dict[int, bytes], dict[int, str]]:
    enc = codec(path)
    own = {enc.encode_single_token(x): x for x in enc.token_byte_values()}
    return own, {i: str(i) for i in own}


@functools.cache
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, low: int, high: int) -> list[int]:
    """Ends of pre-tokens of text that lie in [low, high)."""
    return [e for m in pattern().finditer(text) if low <= (e := m.end()) < high]


def seam(tail: list[int], head: list[int]) -> int | None:
    """The first boundary that two chunks have in common, in positions of the text."""
    common = set(tail).intersection(head)
    return min(common) if common else None


def encode_text(text: str | None, path: str) -> list[int]:
    return codec(path).encode_ordinary(text) if text else []


def encode_chunked(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The same steps for one text in one place; what the distributed form is tested against."""
    starts = list(range(0, max(1, len(text)), chunk))
    parts = [text[s : s + chunk + overlap] for s in starts]
    cut = [0]
    for k in range(1, len(starts)):
        tail = [starts[k - 1] + e for e in boundaries(parts[k - 1], chunk, len(parts[k - 1]) - MARGIN)]
        head = [starts[k] + e for e in boundaries(parts[k], 0, overlap)]
        cut.append(seam(tail, head))
    if None in cut:
        return encode_text(text, path)
    return [i for a, b in zip(cut, [*cut[1:], len(text)], strict=True) for i in encode_text(text[a:b], path)]


DIGESTS = "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def finished(doc_id: pd.Series, ids: Iterable[list[int]], path: str) -> pd.DataFrame:
    """Rows of DIGESTS: the ids packed, and hashes of their decimal list and of the bytes they decode to."""
    names = tables(path)[1]
    made = []
    for x in ids:
        data = packed(x)
        made.append((data, len(x), hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest(), hashlib.sha256(decode(data, path)).hexdigest()))
    return pd.concat([doc_id.reset_index(drop=True).rename("doc_id"), pd.DataFrame(made, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and the columns of DIGESTS: one row for each row of docs. ids: little-endian uint32."""
    bounded_batches(docs.sparkSession)
    rows = texts_of(docs)
    size = F.length(F.coalesce("text", F.lit("")))
    short, long = rows.where(size <= chunk + overlap), rows.where(size > chunk + overlap)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield finished(x["doc_id"], (encode_text(t, path) for t in x["text"]), path)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                starts = range(0, len(text), chunk)
                yield pd.DataFrame({"doc_id": [doc_id] * len(starts), "digest": hashlib.sha256(text.encode()).hexdigest(), "k": range(len(starts)), "part": [text[s : s + chunk + overlap] for s in starts]})

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            head = [[k * chunk + e for e in boundaries(t, 0, overlap)] for t, k in zip(x["part"], x["k"], strict=True)]
            tail = [[k * chunk + e for e in boundaries(t, chunk, len(t) - MARGIN)] for t, k in zip(x["part"], x["k"], strict=True)]
            yield x.assign(head=head, tail=tail)

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = []
            for r in x.itertuples():
                if r.broken:  # its text goes on, to be encoded in one piece
                    made.append(r.part[:chunk].encode())
                else:
                    made.append(packed(encode_text(r.part[int(r.start) - r.k * chunk : int(r.stop) - r.k * chunk], path)))
            yield x[["doc_id", "digest", "k", "broken", "times"]].assign(piece=made)

    def join_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ids = (encode_text(b"".join(p).decode(), path) if broken else np.frombuffer(b"".join(p), "<u4").tolist() for p, broken in zip(x["pieces"], x["broken"], strict=True))
            yield finished(x["doc_id"], ids, path).assign(times=x["times"].to_numpy())

    key = "doc_id string, digest string, k int"
    # equal rows are encoded once; chunks are dealt one by one, so that a long text is no long task
    parts = long.mapInPandas(cut, f"{key}, part string").groupBy("doc_id", "digest", "k").agg(F.first("part").alias("part"), F.count("*").alias("times"))
    parts = parts.mapInPandas(pretokenise, f"{key}, part string, times long, head array<int>, tail array<int>")
    order = W.partitionBy("doc_id", "digest").orderBy("k")
    start = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(order), "head")))
    parts = parts.withColumn("start", start).drop("head", "tail")
    stop = F.coalesce(F.lead("start").over(order), F.col("k") * chunk + F.length("part"))
    parts = parts.withColumns({"stop": stop, "broken": F.max(F.col("start").isNull()).over(W.partitionBy("doc_id", "digest"))})
    done = parts.repartition("doc_id", "digest", "k").mapInPandas(encode_pieces, f"{key}, broken boolean, times long, piece binary")
    joined = done.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("s"), F.first("broken").alias("broken"), F.first("times").alias("times"))
    joined = joined.select("doc_id", F.col("s.piece").alias("pieces"), "broken", "times").mapInPandas(join_pieces, f"doc_id string, {DIGESTS}, times long")
    joined = joined.withColumn("n", F.explode(F.expr("array_repeat(0, int(times))"))).drop("n", "times")
    return typed_id(short.mapInPandas(whole, f"doc_id string, {DIGESTS}").union(joined), docs)


def decode(ids: bytes, path: str) -> bytes:
    return b"".join(map(tables(path)[0].__getitem__, np.frombuffer(ids, "<u4").tolist()))

"""Embedders: a protocol, and one that works offline and always gives the same vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import python_tokens


#: Texts that an embedder gets at once; a worker sends their vectors on before it takes the next ones.
SLICE = 512


def _slices(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield from (x.iloc[at : at + SLICE] for at in range(0, len(x), SLICE))


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str], task: str) -> np.ndarray: ...


@lru_cache(1 << 16)
def _place(token: str, dimension: int) -> tuple[int, float]:
    digest = hashlib.md5(token.encode()).hexdigest()
    return int(digest[:8], 16) % dimension, 1.0 if int(digest[8], 16) < 8 else -1.0


@dataclass(frozen=True)
class HashingEmbedder:
    """Feature hashing: a token adds its sign to its bucket; the sum is normalised. The task makes no difference."""

    dimension: int = 64

    def embed(self, texts: list[str], task: str = "document") -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            if places := [_place(token, self.dimension) for token in python_tokens(text)]:
                buckets, signs = zip(*places, strict=True)
                row += np.bincount(buckets, signs, self.dimension)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0).astype(np.float32)


def embed_query(embedder: Embedder, text: str) -> np.ndarray:
    """The vector of a query; blank queries are refused."""
    if not text or not text.strip():
        raise ValueError("the text must not be empty")
    return wrapped(embedder, [text], "query")[0]


def wrapped(embedder: Embedder, texts: list[str], task: str) -> np.ndarray:
    try:
        return embedder.embed(texts, task)
    except Exception as e:
        raise RuntimeError(f"embedding failed: {e}") from e


def embed_column(embedder: Embedder, text: Column) -> Column:
    """Vectors of a text column by Arrow batches; blank texts fail the job, null texts have no vector."""
    return embed_function(embedder)(text)


def embed_function(embedder: Embedder):
    """What embed_column applies, as a function to register."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in _slices(batches):
            there = x.notna()
            if (x[there].str.strip() == "").any():
                raise ValueError("the text must not be empty")
            made = iter(wrapped(embedder, x[there].tolist(), "document") if there.any() else ())
            yield pd.Series([next(made) if t else None for t in there], dtype=object)

    return run


def try_embed_column(embedder: Embedder, text: Column) -> Column:
    """Vectors of a text column by Arrow batches; blank and null texts, and batches that the embedder refuses, have none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in _slices(batches):
            there = x.notna() & (x.str.strip() != "")
            try:
                made = iter(wrapped(embedder, x[there].tolist(), "document") if there.any() else ())
            except RuntimeError:
                there &= False
                made = iter(())
            yield pd.Series([next(made) if t else None for t in there], dtype=object)

    return run(text)


class QueryCache:
    """An embedder whose queries are embedded once, the latest `size` of them kept. Documents go straight through."""

    def __init__(self, embedder: Embedder, size: int = 1024):
        self.embedder, self.dimension = embedder, embedder.dimension
        self.query = lru_cache(size)(lambda text: embedder.embed([text], "query")[0])

    def embed(self, texts: list[str], task: str = "document") -> np.ndarray:
        return np.stack([self.query(t) for t in texts]) if task == "query" and texts else self.embedder.embed(texts, task)

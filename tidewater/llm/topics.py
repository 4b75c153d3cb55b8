"""Topics: spherical k-means over hashed words, fitted on all texts.

A text is the square roots of its word counts in WIDTH hash buckets, scaled to length one. Centroids start from a bounded
sample (the START texts of the least hashes); every round then assigns all texts and takes the mean of each topic, until
the mean similarity no longer rises. Texts without words have no topic. Topics are numbered by size, largest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts
from tidewater.llm.tokens import hashed_words

WIDTH, START, ROUNDS, RISE, GRID = 64, 4096, 15, 1e-4, 1 << 20


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text, zero if it has no words, and the number of its words."""
    h, counts = hashed_words(texts)
    at = np.repeat(np.arange(len(counts)), counts) * WIDTH + (h.view(np.uint64) % np.uint64(WIDTH)).astype(np.int64)
    made = np.sqrt(np.bincount(at, minlength=len(counts) * WIDTH).reshape(len(counts), WIDTH))
    return (made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)).astype(np.float16), counts


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The topic of each vector; -1: it is zero."""
    x = x.astype(np.float64)
    return np.where(x.any(axis=1), (x @ centroids.T).argmax(axis=1), -1)


def begin(sample: np.ndarray, topics: int) -> np.ndarray:
    """Centroids spread over the sample: each next one is drawn by its distance from those before, then ten rounds."""
    rng, x = np.random.default_rng(1), sample.astype(np.float64)
    centroids = x[:1]
    for _ in range(min(topics, len(x)) - 1):
        far = np.maximum(1 - (x @ centroids.T).max(axis=1), 0) + 1e-9
        centroids = np.concatenate([centroids, x[rng.choice(len(x), p=far / far.sum())][None]])
    for _ in range(10):
        at = nearest(x, centroids)
        centroids = unit(np.stack([x[at == k].sum(axis=0) if (at == k).any() else centroids[k] for k in range(len(centroids))]))
    return centroids


def hashed(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns, n (words) and v (the vector) of each row."""
    schema = docs.select(*kept).schema.add("n", "long").add("v", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v, n = vectors(x.column(0))
            rows = pa.array([r.tobytes() for r in v], pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns[1:], pa.array(n), rows], [*kept, "n", "v"])

    return docs.select("text", *kept).mapInArrow(run, schema)


def stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, WIDTH)


def fit(rows: DataFrame, topics: int, cuts: Cuts) -> tuple[np.ndarray, list[float]]:
    """Centroids of the rows' vectors v, and the mean similarity after each round."""
    some = rows.where("n > 0").orderBy(F.xxhash64("v"), "v").limit(START).select("v").toPandas()["v"]
    if not len(some):
        return np.zeros((0, WIDTH)), []
    centroids, risen = begin(np.stack([np.frombuffer(v, np.float16) for v in some]), topics), []
    while True:
        k = len(centroids)

        def run(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids, k: int = k) -> Iterator[pa.RecordBatch]:
            # integers, so that sums don't depend on their order; behind a topic's sums stand its size and similarity
            sums = np.zeros((k, WIDTH + 2), np.int64)
            for x in batches:
                v = stacked(x.column(0)).astype(np.float64)
                at = nearest(v, centroids)
                v, at = v[at >= 0], at[at >= 0]
                near = (v * centroids[at]).sum(axis=1)
                np.add.at(sums, at, np.rint(np.column_stack([v, np.ones(len(v)) / GRID, near]) * GRID).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "x"])

        found = rows.select("v").mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).toPandas()  # topics by width
        sums = np.zeros((k, WIDTH + 2))
        sums.ravel()[found["at"].to_numpy(np.int64)] = found["x"]
        size = sums[:, WIDTH]
        risen.append(float(sums[:, WIDTH + 1].sum() / GRID / max(size.sum(), 1)))
        if len(risen) >= ROUNDS or (len(risen) > 1 and risen[-1] - risen[-2] < RISE):
            return centroids[np.lexsort((np.arange(k), -size))], risen
        centroids = np.where(size[:, None] > 0, unit(sums[:, :WIDTH]), centroids)

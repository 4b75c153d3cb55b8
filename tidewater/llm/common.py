"""Shared pieces: words, lineage cuts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.shared import scratch

#: ASCII white space, the only separators of words.
SPACE = "\\x20\\x09-\\x0D"


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8; bytes.split() cuts at exactly the six ASCII blanks.

    A lone surrogate cannot come out of Spark's UTF-8, so encoding never fails there.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of whole texts by bytes as well as rows, so that a worker's memory doesn't follow their lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def bounded(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """bounded_batches for the jobs that run inside; the session has its own settings again afterwards."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    bounded_batches(spark, rows, size)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def set_aside(docs: DataFrame, *needed: str | None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column but the needed ones under a name that no operator uses, and what names them back.

    So whatever columns a table has, they neither clash with those that an operator adds nor get lost.
    """
    own, keep = docs.columns, {n.lower() for n in needed if n}
    names = {c: f"_own{i}" for i, c in enumerate(own) if c.lower() not in keep}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(names[c] if c in names else f"`{c}`").alias(c) for c in own])

    return docs.withColumnsRenamed(names), back


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id as a string, text, and more: what workers get. Integers next to nulls would become floats in pandas."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *more)


def typed_id(df: DataFrame, like: DataFrame) -> DataFrame:
    """doc_id in its type again."""
    return df.withColumn("doc_id", F.col("doc_id").cast(like.schema["doc_id"].dataType))


class Cuts:
    """Tables written to the shared folder. A written table costs one pass, where checkpoint() would run the plan twice.

    They go when `only` says so, and the rest when the driver's JVM ends. Spark removes the shuffle files and broadcasts
    of plans that nothing refers to any more when the driver collects its garbage, which a driver with memory to spare
    rarely does by itself; so it is asked to every SWEEP tables.
    """

    SWEEP = 8

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, scratch(spark, "cut"), 0
        self.files = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.held: set[str] = set()

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        self.held.add(path)
        if self.n % self.SWEEP == 0:
            self.sweep()
        return out

    def sweep(self) -> None:
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Removes a written table that no later plan reads."""
        self.held.discard(df._cut_path)
        self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._cut_path), True)

    def only(self, *kept: DataFrame) -> None:
        """Removes all written tables but these."""
        for path in self.held - {df._cut_path for df in kept}:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.held = {df._cut_path for df in kept}
        self.sweep()


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes along edges a-b (min-label hooking with pointer jumping)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def components(edges: DataFrame, cuts: Cuts, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    Alternating large-star and small-star steps: each hangs a node's neighbours on the smallest one. A step is a
    map-side combined minimum and an equi-join whose hot keys adaptive execution can split; no neighbourhood is
    gathered into one row. Rounds grow with the logarithm of a component's diameter. Empty edges: no rows.
    """
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u").distinct()
    now = cuts.write(now)
    before = _digest(now)
    while True:
        # large star: every larger neighbour of x moves to the least of x and its neighbours
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = cuts.write(large)
        # small star: the smaller neighbours of v, and v itself, move to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = cuts.write(moved.union(low.select("v", F.col("m").alias("u"))).distinct())
        same, before = (found := _digest(new)) == before, found
        cuts.drop(now)
        cuts.drop(large)
        now = new
        if same:
            break
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())

"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, *order, name: str = "rank", most: int | None = None) -> DataFrame:
    """rows with their place by `order`. The window has no partitions, so it comes behind a top-k."""
    if most is not None:
        rows = rows.orderBy(*order).limit(most)
    return rows.withColumn(name, F.row_number().over(W.orderBy(*order)))


def reciprocal_rank(lists: list[DataFrame], id_col: str = "doc_id", k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """id_col, score, rank_0, rank_1, ...: the sum of weight / (k + rank) over ranked lists (id_col, rank).

    One union and one aggregation, for any number of lists.
    """
    weights = weights or [1.0] * len(lists)
    tagged = [x.select(id_col, F.col("rank").alias("rank"), F.lit(i).alias("list"), F.lit(w).alias("w")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    both = reduce(DataFrame.unionByName, tagged)
    places = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return both.groupBy(id_col).agg(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))).alias("score"), *places)

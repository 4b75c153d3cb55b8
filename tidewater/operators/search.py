"""Vector search and hybrid search, over chunks with parents or over whole documents.

`candidates` and `facet_mode` give both known behaviours: with candidates, the nearest chunks are taken first and
facets filter what they belong to ("post"), so fewer rows than the limit may come back; with none every vector is
compared, and facets apply before ("pre").
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import context_text, vector_text
from tidewater.functions.vectors import cosine_distance, literal
from tidewater.operators import fulltext
from tidewater.operators.chunking import TextSplitter, chunk
from tidewater.operators.embedding import Embedder, embed_column, embed_query
from tidewater.operators.fusion import ranked, reciprocal_rank

OVERSAMPLE, BRANCH = 10, 100
#: Queries whose distances to a block of rows a task holds at once, and the most of these distances.
BATCH, CELLS = 256, 1 << 21
#: Blocks of a side, as long as they hold neither fewer vectors than LEAST nor more components than MOST.
BLOCKS, LEAST, MOST = 6, 1024, 1 << 22


def facet_filter(df: DataFrame, facets: dict) -> Column:
    """All columns equal the given values; names are checked, and null equals nothing."""
    unknown = set(facets) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in facets.items()], F.lit(True))


def nearest(vectors: DataFrame, query, k: int | None, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int | None = 6) -> DataFrame:
    """vectors and distance, the k nearest (None: all). Vectors without a direction have a null distance and come last.

    Rows are ranked by the whole distance; digits: what it is rounded to then (None: it isn't).
    """
    rows = vectors.withColumn("distance", cosine_distance(F.col(vector_col), literal(query))).drop(vector_col)
    if k is not None:
        rows = rows.orderBy(F.asc_nulls_last("distance"), F.asc(id_col)).limit(k)
    return rows if digits is None else rows.withColumn("distance", F.round("distance", digits))


def _best(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, id, distance) of the k nearest rows of each unit vector of q, in the order of (distance, id)."""
    distance = np.round(1.0 - q @ rows.T, digits)
    edge = np.partition(distance, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
    i, j = np.nonzero(distance <= edge[:, None])
    order = np.lexsort((ids[j], distance[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j = i[place < k], j[place < k]
    return i, ids[j], distance[i, j]


def blocks_of(n: int, dims: int) -> int:
    """Into how many blocks n vectors are dealt."""
    return max(1, -(-n // max(1, min(max(LEAST, -(-n // BLOCKS)), MOST // max(1, dims)))))


def nearest_many(queries: DataFrame, rows: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "chunk_id", vector_col: str = "embedding", *, others: bool = False, digits: int = 9, block: int | None = None) -> DataFrame:
    """(query_id, id_col, distance, rank): the k nearest rows by cosine distance of every query, all queries at once.

    Queries and rows are dealt to blocks by hash, and each pair of blocks is one matrix product in a task of its own,
    which gives k rows a query; what is shuffled are the vectors, once for each block of the other side, and k rows for
    each query and block of rows. There are BLOCKS of a side until they hold MOST components, so that what is shuffled
    grows no faster than the tables up to there; floats are shuffled as floats. A task holds two blocks and some rows of their product. others: a
    row is no neighbour of the query with its own id. Distances are rounded to `digits`, equal ones are ordered by id.

    Vectors that are null, empty, zero or hold null or non-finite components, and null ids, are no neighbours and have
    none; vectors of different lengths raise ValueError.
    """
    single = all(df.schema[vector_col].dataType.simpleString() == "array<float>" for df in (queries, rows))
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    usable = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = lambda df, key: df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null").where(usable)
    q, r = clean(queries, query_id), clean(rows, id_col)
    sizes = [df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first() for df in (q, r)]
    n_q, n_r = (max(1, -(-n // block)) if block else blocks_of(n, dims) for n, dims in sizes)
    deal = lambda df, own, n, other, m, is_query: df.select("id", "v", F.lit(is_query).alias("is_query"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    both = deal(q, "qb", n_q, "rb", n_r, True).unionByName(deal(r, "rb", n_r, "qb", n_q, False))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        if x["is_query"].all() or not x["is_query"].any():
            return made
        if x["v"].map(len).nunique() > 1:
            raise ValueError("vectors must have one length")
        ids, asks = x["id"].to_numpy(), x["is_query"].to_numpy()

        def unit(some: np.ndarray) -> np.ndarray:
            out = np.stack(x["v"].to_numpy()[some]).astype(np.float64)
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            return out

        own, asked, against, held, found = ids[asks], unit(asks), unit(~asks), ids[~asks], []
        step = min(BATCH, max(1, CELLS // len(held)))
        for s in range(0, len(own), step):
            i, near, distance = _best(asked[s : s + step], against, held, k + others, digits)
            found.append(pd.DataFrame({"query": own[s + i], "id": near, "distance": distance}))
        made = pd.concat(found)
        return made[made["query"] != made["id"]] if others else made

    near = both.groupBy("qb", "rb").applyInPandas(run, "query long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    best = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("query").alias(query_id), F.col("id").alias(id_col), "distance", "rank")


AGGREGATES = {"min": F.min, "avg": F.avg, "max": F.max}


def vector_search(parents: DataFrame, vectors: DataFrame, query, limit: int = 10, *, facets: dict | None = None, facet_mode: str = "post", exact: bool = False, agg: str = "min", parent_id: str = "doc_id") -> DataFrame:
    """(parent_id, distance, best_chunk, rank): parents by the distances of their chunks.

    vectors: chunk_id, parent_id, embedding. Ids are ranked on; whole rows are joined by `hydrate`.
    """
    facets = facets or {}
    allowed = parents.where(facet_filter(parents, facets)).select(parent_id)
    if facet_mode == "pre":
        vectors = vectors.join(allowed, parent_id, "left_semi")
    hits = nearest(vectors, query, None if exact else OVERSAMPLE * limit, digits=None)
    if facet_mode == "post":
        hits = hits.join(allowed, parent_id, "left_semi")
    best = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "chunk_id")))["chunk_id"].alias("best_chunk")
    found = hits.groupBy(parent_id).agg(AGGREGATES[agg]("distance").alias("distance"), best)
    return ranked(found, F.asc_nulls_last("distance"), F.asc(parent_id), most=limit).withColumn("distance", F.round("distance", 6))


def hybrid_search(parents: DataFrame, vectors: DataFrame, index: fulltext.Index, query, text: str, limit: int = 10, *, k: int = 60, facets: dict | None = None, facet_mode: str = "post", exact: bool = False, parent_id: str = "doc_id", parse_mode: str = "fts") -> DataFrame:
    """(parent_id, score, rank_0 by vectors, rank_1 by text, rank): both branches capped, then fused by rank."""
    allowed = parents.where(facet_filter(parents, facets or {})).select(F.col(parent_id).alias("doc_id"))
    hits = vectors.join(allowed, vectors[parent_id] == allowed["doc_id"], "left_semi") if facet_mode == "pre" else vectors
    hits = nearest(hits, query, None if exact else OVERSAMPLE * limit, digits=None)
    if facet_mode == "post":
        hits = hits.join(allowed, hits[parent_id] == allowed["doc_id"], "left_semi")
    near = hits.groupBy(F.col(parent_id).alias("doc_id")).agg(F.min("distance").alias("distance"))
    near = ranked(near, F.asc_nulls_last("distance"), F.asc("doc_id"), most=BRANCH)
    words = fulltext.search(index, text, BRANCH, allowed, parse_mode)
    fused = reciprocal_rank([near, words], "doc_id", k)
    fused = fused.withColumn("score", F.round("score", 12))
    return ranked(fused, F.desc("score"), F.asc_nulls_last("rank_0"), F.asc("doc_id"), most=limit).withColumnRenamed("doc_id", parent_id)


def hydrate(results: DataFrame, parents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Whole rows of the ranked ids, in order; ids whose row is gone are left out. Whether the ids are broadcast is left
    to their size."""
    return parents.join(results, id_col).orderBy("rank")


def facet_counts(parents: DataFrame, column: str) -> DataFrame:
    return parents.groupBy(column).agg(F.count("*").alias("n"))


def row_search(rows: DataFrame, query, limit: int = 10, *, facets: dict | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, distance, rank) of whole documents with one vector each: facets apply before the nearest are taken."""
    found = nearest(rows.where(facet_filter(rows, facets or {})).select(id_col, vector_col), query, None, id_col, vector_col, None)
    return ranked(found, F.asc_nulls_last("distance"), F.asc(id_col), most=limit).withColumn("distance", F.round("distance", 6))


def metadata_filter(df: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose metadata (a map) has all wanted values."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(column)[k] == F.lit(v), F.lit(False)) for k, v in wanted.items()], F.lit(True)))


def with_match_type(results: DataFrame) -> DataFrame:
    """Fused results and match_type: what found a row, VECTOR, FTS or HYBRID."""
    near, words = F.col("rank_0").isNotNull(), F.col("rank_1").isNotNull()
    return results.withColumn("match_type", F.when(near & words, "HYBRID").when(near, "VECTOR").otherwise("FTS"))


@dataclass(frozen=True)
class SearchIndex:
    """A declared index over a table of documents: what is searched, what gives context, and what may be filtered by."""

    parents: DataFrame
    vectors: DataFrame
    words: fulltext.Index
    embedder: Embedder
    parent_id: str = "doc_id"
    filters: tuple[str, ...] = ()

    @staticmethod
    def build(docs: DataFrame, content: str, embedder: Embedder, *, context: tuple[str, str] | None = None, fields: tuple[str, ...] = (), filters: tuple[str, ...] = (), parent_id: str = "doc_id", splitter: TextSplitter | None = None) -> SearchIndex:
        """context: the columns of category and title that are embedded with each chunk; fields: further columns of words."""
        cut = chunk(docs.where(F.trim(content) != ""), parent_id, content, splitter).select(parent_id, "chunk_index", F.col("content").alias("_piece"))
        named = docs.select(parent_id, (context_text(F.col(context[0]), F.col(context[1])) if context else F.lit("")).alias("_context"))
        rows = cut.join(named, parent_id).select(F.xxhash64(parent_id, "chunk_index").alias("chunk_id"), parent_id, embed_column(embedder, vector_text(F.col("_context"), F.col("_piece"))).alias("embedding"))
        return SearchIndex(docs, rows, fulltext.build(docs, dict.fromkeys((*fields, content)), parent_id), embedder, parent_id, filters)

    def _facets(self, facets: dict | None) -> dict:
        if unknown := set(facets or {}) - set(self.filters):
            raise ValueError(f"not declared as filters: {sorted(unknown)}")
        return facets or {}

    def vector(self, text: str, limit: int = 10, facets: dict | None = None) -> DataFrame:
        return vector_search(self.parents, self.vectors, embed_query(self.embedder, text).tolist(), limit, facets=self._facets(facets), parent_id=self.parent_id)

    def fts(self, text: str, limit: int = 10, facets: dict | None = None, parse_mode: str = "fts") -> DataFrame:
        allowed = self.parents.where(facet_filter(self.parents, self._facets(facets))).select(F.col(self.parent_id).alias("doc_id"))
        return fulltext.search(self.words, text, limit, allowed, parse_mode).withColumnRenamed("doc_id", self.parent_id)

    def hybrid(self, text: str, limit: int = 10, facets: dict | None = None, parse_mode: str = "plain") -> DataFrame:
        found = hybrid_search(self.parents, self.vectors, self.words, embed_query(self.embedder, text).tolist(), text, limit, facets=self._facets(facets), parent_id=self.parent_id, parse_mode=parse_mode)
        return with_match_type(found)

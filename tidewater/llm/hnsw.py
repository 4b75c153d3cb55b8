"""Embedding near-dedup with hierarchical navigable small-world graphs.

Vectors of a label are dealt to shards of bounded size; each shard gets a graph of layers, and every vector of the label
queries every shard. Searches run in lockstep over blocks of queries. A query whose beam holds nothing but links is
searched again with a wider one, and beyond the widest against all rows of the shard. Each shard audits itself: for
a spread of its rows, and of each batch of queries of other shards, links and nearest rows (never a row's match with
itself) are compared with brute force, and beams widen until enough of both are found; where even the widest beam fails,
the shard is searched by blocks of brute force. Links are verified by cosine in double precision.

Equal vectors of a label are one row of the index, with their number. A task streams its queries: it holds one shard
and one batch. Where a shard has more than QUERIES queries of other shards, they are dealt to several tasks, each with
the shard. Links within a shard are bits (32 MB at 16,384 rows), those of a batch are counted block by block; what is
emitted is a spanning forest, never the pairs of a dense group. Components are the connected components of the forests.

Defined results: vectors that are null, zero or hold null or non-finite components, and those with a null label or id,
link with nothing; neither do vectors of different lengths; every row is a vector, so repeated rows link with each
other; component_id is then the row's own vec_id; further columns, whatever their names, are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, components

SIMILARITY, SHARD = 0.98, 1 << 14
DEGREE, WIDTHS, AUDIT, RECALL = 24, (32, 64, 128, 256), 64, 0.98
BLOCK, BATCH, PAIRS, SLACK = 512, 1024, 1 << 15, 1e-4
QUERIES = 1 << 20


def diverse(own: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours for each row of own from candidates ids (-1: none): a candidate is taken if it is nearer
    to its row than to any taken before; places left over go to the nearest of the rest."""
    sim = np.where(ids >= 0, np.einsum("bd,bcd->bc", own, x[np.maximum(ids, 0)]), -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    vectors = x[np.maximum(ids, 0)]
    among = vectors @ vectors.transpose(0, 2, 1)
    b, c = ids.shape
    taken, nearest = np.zeros((b, c), bool), np.full((b, c), -np.inf, np.float32)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (nearest[:, j] < sim[:, j]) & (taken.sum(axis=1) < degree)
        taken[:, j] = ok
        nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j]), nearest)
    rank = np.argsort(np.where(ids < 0, 2, ~taken), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, rank, 1)
    return out if out.shape[1] == degree else np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """Rows are held in the order of their levels, highest first: layer l is the first sizes[l] rows."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        n = len(vectors)
        unit = vectors.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        draws = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(DEGREE)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.exact, self.x = unit[self.order], unit[self.order].astype(np.float32)
        self.sizes = [int((level >= k).sum()) for k in range(level.max(initial=0) + 1)]
        self.layers: list[np.ndarray] = [np.empty((0, DEGREE), np.int64)] * len(self.sizes)
        for k in reversed(range(len(self.sizes))):
            self.grow(k)

    def grow(self, k: int) -> None:
        n, x = self.sizes[k], self.x
        self.layers[k] = adj = np.full((n, DEGREE), -1, np.int64)
        done = min(n, DEGREE + 1)
        for i in range(done):
            others = np.delete(np.arange(done), i)
            adj[i, : len(others)] = others
        while done < n:
            new = np.arange(done, min(n, done + min(done, BATCH)))
            own = x[new]
            found, _ = self.beam(k, own, self.entry(own, k, done), 2 * DEGREE, done)
            near = own @ own.T
            np.fill_diagonal(near, -np.inf)
            width = min(8, len(new) - 1)
            if width > 0:
                found = np.concatenate([found, new[np.argpartition(-near, width - 1, axis=1)[:, :width]]], axis=1)
            adj[new] = diverse(own, found, x, DEGREE)
            # and back
            a, b = np.repeat(new, DEGREE), adj[new].ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), b))
            a, b = a[order], b[order]
            nodes, start, count = np.unique(b, return_index=True, return_counts=True)
            more = np.arange(DEGREE)
            extra = np.where(more < count[:, None], a[np.minimum(start[:, None] + more, len(a) - 1)], -1)
            extra[(extra[:, :, None] == adj[nodes][:, None, :]).any(axis=2)] = -1
            for s in range(0, len(nodes), BATCH):
                at = slice(s, s + BATCH)
                adj[nodes[at]] = diverse(x[nodes[at]], np.concatenate([adj[nodes[at]], extra[at]], axis=1), x, DEGREE)
            done = new[-1] + 1

    def entry(self, q: np.ndarray, k: int, limit: int) -> np.ndarray:
        """Where to enter layer k: the nearest row found in the layers above."""
        at = np.zeros(len(q), np.int64)
        for above in reversed(range(k + 1, len(self.sizes))):
            at = self.beam(above, q, at, 1, self.sizes[above])[0][:, 0]
        return np.where(at < limit, at, 0)

    def beam(self, k: int, q: np.ndarray, at: np.ndarray, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest rows that a search from `at` finds for each query, and their similarities."""
        adj, x, n = self.layers[k], self.x, len(q)
        ids, sim, todo = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)
        ids[:, 0], sim[:, 0], todo[:, 0] = at, np.einsum("ij,ij->i", q, x[at]), True
        seen = np.zeros((n, limit), bool)
        seen[np.arange(n), at] = True
        live = np.arange(n)
        while len(live):
            score = np.where(todo[live], sim[live], -np.inf)
            best = score.argmax(axis=1)
            more = score[np.arange(len(live)), best] > -np.inf
            live, best = live[more], best[more]
            if not len(live):
                break
            todo[live, best] = False
            near = adj[ids[live, best]]
            valid = (near >= 0) & (near < limit)
            near = np.where(valid, near, 0)
            valid &= ~seen[live[:, None], near]
            r, c = np.nonzero(valid)
            seen[live[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", q[live[r]], x[near[r, c]])
            # most rows far into a search find nothing better than what their beam holds
            gains = (s > sim[live].min(axis=1)[:, None]).any(axis=1)
            rows, s, near = live[gains], s[gains], near[gains]
            every = np.concatenate([sim[rows], s], axis=1)
            top = np.argpartition(-every, width - 1, axis=1)[:, :width]
            at = np.arange(len(rows))[:, None]
            sim[rows] = every[at, top]
            ids[rows] = np.concatenate([ids[rows], np.where(s > -np.inf, near, -1)], axis=1)[at, top]
            todo[rows] = np.concatenate([todo[rows], s > -np.inf], axis=1)[at, top]
        return ids, sim


class Shard:
    """The graph of a shard, with beams as wide as its audit asks for; rows are numbered as given."""

    def __init__(self, vectors: np.ndarray, similarity: float = SIMILARITY):
        self.graph, self.similarity, self.n = Graph(vectors), similarity, len(vectors)
        self.width: int | None = WIDTHS[0] if WIDTHS[0] < self.n else None  # None: brute force
        self.recall = 1.0
        probe = np.unique(np.linspace(0, self.n - 1, min(self.n, AUDIT)).astype(int))
        self.settle(self.graph.exact[probe], probe)

    def settle(self, q: np.ndarray, own: np.ndarray | None = None) -> None:
        """Widens the beam until it finds enough of the links and of the nearest rows of q, each counted by itself.

        own: the rows that the queries are, which are no evidence. Every query has a nearest row, linked or not.
        """
        if self.width is None or not len(q):
            return
        at, short = np.arange(len(q)), q.astype(np.float32)
        every = short @ self.graph.x.T
        if own is not None:
            every[at, own] = -np.inf
        nearest = every.max(axis=1)

        def others(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            """Pairs as numbers, without rows' matches with themselves."""
            return np.unique(np.concatenate([(i * self.n + j)[own[i] != j] if own is not None else i * self.n + j for i, j in found]))

        truth = others(self.brute(q))
        for width in WIDTHS[WIDTHS.index(self.width) :]:
            if width >= self.n:
                break
            ids, sim = self.graph.beam(0, short, self.graph.entry(short, 0, self.n), width, self.n)
            if own is not None:
                sim = np.where(ids == own[:, None], -np.inf, sim)
            self.recall = float((sim.max(axis=1) >= nearest - 1e-5).mean())
            if len(truth):
                self.recall = min(self.recall, float(np.isin(truth, others(self.narrow(q, width)), assume_unique=True).mean()))
            if self.recall >= RECALL:
                self.width = width
                return
        self.width = None

    def verified(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros(len(i), bool)
        for s in range(0, len(i), PAIRS):  # what is gathered of vectors is bounded
            at = slice(s, s + PAIRS)
            near[at] = np.einsum("ij,ij->i", q[i[at]], self.graph.exact[j[at]]) >= self.similarity
        return i[near], j[near]

    def brute(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified links of the queries with all rows, some rows at a time. Similarities in single precision err by less
        than the slack, so only those within it of the least are worked out in double precision."""
        short, slack = q.astype(np.float32), max(SLACK, 2e-7 * q.shape[1])
        for s in range(0, self.n, BLOCK * 8):
            sim = short @ self.graph.x[s : s + BLOCK * 8].T
            sure = sim >= self.similarity + slack
            i, j = np.nonzero(sure)
            yield i, j + s
            i, j = np.nonzero((sim >= self.similarity - slack) & ~sure)
            yield self.verified(q, i, j + s)

    def narrow(self, q: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified links of the queries; those with a beam full of links are searched again more widely."""
        own = q.astype(np.float32)
        ids, sim = self.graph.beam(0, own, self.graph.entry(own, 0, self.n), width, self.n)
        close = sim >= self.similarity - SLACK
        full = close.all(axis=1)
        i, j = np.nonzero(close & ~full[:, None])
        yield self.verified(q, i, ids[i, j])
        if full.any():
            again = np.flatnonzero(full)
            for i, j in self.narrow(q[again], 4 * width) if 4 * width <= min(WIDTHS[-1], self.n) else self.brute(q[again]):
                yield again[i], j

    def own(self, vectors: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many links each row has with other rows (each counted `times`), and the least row of its component.

        A link counts if either of its rows has found it. Links are bits, a row of them for each row of the shard.
        """
        bits = np.zeros((self.n, -(-self.n // 8)), np.uint8)
        now, block = 0, np.zeros((min(BLOCK, self.n), self.n), bool)

        def put() -> None:
            rows = block[: min(BLOCK, self.n - now)]
            rows[np.arange(len(rows)), now + np.arange(len(rows))] = False
            bits[now : now + len(rows)] |= np.packbits(rows, axis=1)
            bits[:, now // 8 : -(-(now + len(rows)) // 8)] |= np.packbits(rows.T, axis=1)

        for i, j in self.links(vectors):
            if len(i) and i[0] // BLOCK * BLOCK != now:
                put()
                block[:] = False
                now = int(i[0]) // BLOCK * BLOCK
            block[i - now, j] = True
        put()
        links, label, left = np.zeros(self.n, np.int64), np.arange(self.n), np.ones(self.n, bool)
        for s in range(0, self.n, BLOCK):
            links[s : s + BLOCK] = np.unpackbits(bits[s : s + BLOCK], axis=1, count=self.n) @ times
        for row in np.flatnonzero(links):
            if not left[row]:
                continue
            edge = np.array([row])
            while len(edge):  # breadth first
                left[edge], label[edge] = False, row
                reach = np.bitwise_or.reduce([np.bitwise_or.reduce(bits[edge[s : s + BLOCK]], axis=0) for s in range(0, len(edge), BLOCK)], axis=0)
                edge = np.flatnonzero(np.unpackbits(reach, count=self.n).astype(bool) & left)
        return links, label

    def links(self, vectors: np.ndarray, foreign: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, row of the shard), some of a block of queries at a time. Queries of other shards are audited
        as well."""
        q = vectors.astype(np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        if foreign:
            self.settle(q[np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT)).astype(int))])
        for s in range(0, len(q), BLOCK):
            for i, j in self.brute(q[s : s + BLOCK]) if self.width is None else self.narrow(q[s : s + BLOCK], self.width):
                yield i + s, self.graph.order[j]


def search(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by (label, dim, target, slice, query): a shard's members, then the vectors that query it. Only slice 0
    tells of the members' own links."""

    def rows(rep, links, a, b) -> pd.DataFrame:
        return pd.DataFrame({"rep": np.concatenate([rep, a]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]), "other": np.concatenate([np.full(len(rep), -1), b]), "edge": np.concatenate([np.zeros(len(rep), bool), np.ones(len(a), bool)])})

    none = np.empty(0, np.int64)
    key, members, shard = None, [], None

    def opened():
        """Builds the shard from its members and lets them query it: pairs found from either end count for both."""
        x = pd.concat(members, ignore_index=True)
        made = Shard(np.stack(x["embedding"].to_numpy()), similarity)
        made.rep, made.times = x["rep"].to_numpy(), x["times"].to_numpy()
        lead = x["slice"].iloc[0] == 0
        links, made.label = made.own(np.stack(x["embedding"].to_numpy()), made.times)
        label = made.label
        moved = label != np.arange(len(x))
        return made, rows(made.rep, links, made.rep[moved], made.rep[label[moved]]) if lead else rows(none, none, none, none)

    for batch in batches:
        for k, x in batch.groupby(["label", "dim", "target", "slice"], sort=False):
            if k != key:
                if members and shard is None and key[3] == 0:
                    yield opened()[1]
                key, members, shard = k, [], None
            own, queries = x[~x["query"]], x[x["query"]]
            if len(own):
                members.append(own)
            if len(queries):
                if shard is None:
                    shard, out = opened()
                    yield out
                links, touched = np.zeros(len(queries), np.int64), none
                rep = queries["rep"].to_numpy()
                for i, j in shard.links(np.stack(queries["embedding"].to_numpy()), foreign=True):
                    np.add.at(links, i, shard.times[j])
                    # a query joins each group of the shard that it touches once
                    touched = np.union1d(touched, i * shard.n + shard.label[j])
                yield rows(rep, links, rep[touched // shard.n], shard.rep[touched % shard.n])
    if members and shard is None and key[3] == 0:
        yield opened()[1]


def near_copies(vectors: DataFrame, similarity: float = SIMILARITY, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding, label)."""
    cuts = Cuts(vectors.sparkSession)
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite, F.lit(False))
    k1, k2 = F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")
    rows = vectors.select("vec_id", "label", "embedding", usable.alias("usable"), k1.alias("k1"), k2.alias("k2"))
    distinct = rows.where("usable").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.any_value("embedding").alias("embedding"))
    distinct = cuts.write(distinct.withColumn("dim", F.size("embedding")))
    shards = distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.ceil(F.count("*") / queries).cast("int").alias("slices"))
    dealt = distinct.join(shards, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    sent = dealt.select("label", "dim", "rep", "times", "embedding", "own", "slices", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("target"))
    sent = sent.withColumn("query", F.col("own") != F.col("target"))
    one = F.array(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("slices")).cast("int"))
    sent = sent.withColumn("slice", F.explode(F.when(F.col("query"), one).otherwise(F.sequence(F.lit(0), F.col("slices") - 1)))).drop("own", "slices")
    key = ["label", "dim", "target", "slice"]
    sent = sent.repartition(*key).sortWithinPartitions(*key, "query", "rep")
    found = cuts.write(sent.mapInPandas(lambda b: search(b, similarity), "rep long, links long, other long, edge boolean"))
    links = found.where("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("edge").select(F.col("rep").alias("a"), F.col("other").alias("b")), cuts).withColumnRenamed("node", "rep")
    byrep = distinct.select("label", "k1", "k2", "rep", "times").join(links, "rep").join(roots, "rep", "left")
    byrep = byrep.select("label", "k1", "k2", (F.col("links") + F.col("times") - 1).alias("n"), F.coalesce("component", "rep").alias("component")).withColumn("usable", F.lit(True))
    out = rows.drop("embedding").join(byrep, ["usable", "label", "k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

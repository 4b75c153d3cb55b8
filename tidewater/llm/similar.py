"""Near-dedup by the Jaccard similarity of five-word shingles: fingerprints and MinHash for candidates, exact verification.

Texts with equal shingle sets collapse to one node. First op1's binary-trie self-join links the nodes' SimHash
fingerprints (a bit is set if it is set in over half of a set's hashes) at BUDGET or fewer differing bits, and what
reaches the similarity is linked. The trie can't carry a budget that finds all of it, so buckets find the rest, among
nodes that the trie has not connected yet.

A node's BANDS x ROWS minima give BANDS buckets; two sets with a
similarity of 0.8 share a bucket but for three in a million, more similar ones but for fewer.

What two sets have in common is at most what either has in common with anything, and at most a set's size less the
shingles that the other can't have. So of nodes in buckets of DENSE or more, the shingles that no other of these has are
counted first (in smaller buckets it isn't worth the count), and each node has a signature: a bit for the hash of each of
its shingles. A bit that only one of two sets has is a shingle that they don't share. No pair is compared that is bounded
below the similarity: that leaves out, without loss, most of a dense group whose members are edited beyond it, each in its
own way.

Within a bucket links are sought by rounds: some members, ever more of them a round, are compared by their whole
shingle sets with all others of the bucket that aren't in their component yet, and leave it. The first is the one that
shares most buckets with others, as the text that a group's members are copies of does. A bucket is done when its
members are one component or all have been compared. No candidate pair is skipped unless both ends are known to be
connected, or it can't link. A dense group whose members all link to the first costs a comparison a member; one that
takes more rounds may cost up to all pairs that can link.

Defined results: words are lower-cased (A-Z) and cut at ASCII blanks; under five words the whole word sequence is the
only shingle; texts without words are copies of each other; rows with a null doc_id stay and lead no group; an empty
table gives no rows; `drop_similar` keeps further columns, whatever their names, as they are. Shingles are told apart by
64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded_batches, byte_words, components, set_aside, texts_of, typed_id
from tidewater.llm.simhash import link_edges

SHINGLE, SIMILARITY, SEED = 5, 0.8, 43
BANDS, ROWS = 24, 4
#: Bits in which fingerprints may differ for the trie to propose a pair.
BUDGET = 2
#: Pairs of one leader that meet one copy of its set.
FAN = 64
#: Members of a bucket from which on it is worth counting what they have in common with any other.
DENSE = 8
#: Columns of 64 bits that make a signature.
SIGNS = [f"s{i}" for i in range(8)]
BLOCK = 1 << 13
_draw = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS = _draw[0] | np.uint64(1), _draw[1]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def node_of(grams: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(grams.tobytes(), SEED)


def buckets(grams: np.ndarray) -> list[int]:
    if not len(grams):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), BLOCK):
        np.minimum(least, (grams[at : at + BLOCK, None] * TIMES + PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def fingerprint(grams: np.ndarray) -> int:
    """Signed 64-bit SimHash of a shingle set; of the empty set zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        counts += np.unpackbits(grams[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(grams)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def nodes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, fp, buckets): one row per document with an id. mark: a hash of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets = [shingles(t) for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"], "mark": x["mark"], "node": [node_of(s) for s in sets], "fp": [fingerprint(s) for s in sets], "buckets": [buckets(s) for s in sets]})

    rows = texts_of(docs.where("doc_id is not null"), text_mark().alias("mark"))
    return typed_id(rows.mapInPandas(run, "doc_id string, mark long, node string, fp long, buckets array<long>"), docs)


def signature(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * len(SIGNS), bool)
    bits[grams % np.uint64(len(bits))] = True
    return np.packbits(bits).view(np.int64)


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, grams, signature): a row per distinct shingle set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sets = [shingles(t) for t in x["text"]]
            signs = np.stack([signature(s) for s in sets]) if sets else np.empty((0, len(SIGNS)), np.int64)
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "grams": [s.view(np.int64) for s in sets]} | {k: signs[:, i] for i, k in enumerate(SIGNS)})

    return docs.select("text").mapInPandas(run, "node string, grams array<long>, " + ", ".join(f"{k} long" for k in SIGNS)).dropDuplicates(["node"])


def text_mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("\x00")))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity. An a of many pairs is dealt to several copies of its set."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
    of_a = sets.withColumnsRenamed({"node": "a", "grams": "ga"}).join(fans, "a").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")
    dealt = pairs.join(fans, "a").withColumn("slot", F.expr("pmod(xxhash64(b), fan)").cast("int")).drop("fan")
    both = dealt.join(sets.withColumnsRenamed({"node": "b", "grams": "gb"}), "b").join(of_a, ["a", "slot"])
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", common.alias("common"), (F.size("ga") + F.size("gb") - common).alias("all")).where(F.col("common") >= similarity * F.col("all")).select("a", "b")


def trie_pairs(unique: DataFrame, cuts: Cuts) -> DataFrame:
    """(a, b): pairs of nodes (node, fp) that connect all whose fingerprints link, one fewer than nodes or less. Nodes
    with one fingerprint are paired with the least of them, which stands for it in the trie."""
    first = cuts.write(unique.groupBy("fp").agg(F.min("node").alias("first")))
    alike = unique.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = link_edges(first.select("fp"), cuts, BUDGET)
    of = lambda end: first.select(F.col("fp").alias(f"_{end}"), F.col("first").alias(f"n{end}"))
    ends = edges.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b"))
    return cuts.write(alike.union(ends.select(F.least("na", "nb"), F.greatest("na", "nb"))).distinct())


def common_sizes(sets: DataFrame) -> DataFrame:
    """(node, common): how many of a node's shingles any other of these nodes has too."""
    own = F.xxhash64("node")
    each = sets.select(own.alias("h"), F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"), F.min("h").alias("h"))
    alone = each.where("n = 1").groupBy("h").agg(F.count("*").alias("alone"))
    return sets.select("node", F.size("grams").alias("size"), own.alias("h")).join(alone, "h", "left").select("node", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def able_members(members: DataFrame, sets: DataFrame, cuts: Cuts, similarity: float) -> DataFrame:
    """(bucket, node, size, common, signature) without those that have too little in common with all others of dense buckets to link there.

    members: (bucket, node, dense); sets: dense, whether any of a node's buckets is.
    """
    known = cuts.write(sets.select("node", F.size("grams").alias("size"), *SIGNS).join(common_sizes(sets.where("dense")), "node", "left"))
    # what is counted among nodes of dense buckets bounds pairs of these only
    rows = members.join(known, "node").withColumn("common", F.when(F.col("dense"), F.col("common")).otherwise(F.col("size"))).drop("dense")
    return rows.where(F.col("common") >= similarity * F.col("size") - 1e-6)


def may_link(similarity: float):
    """Whether a node and the leader beside it (columns ending in _a) can reach the similarity; a little less, for the sake of rounding."""
    lost = lambda x, y: reduce(add, [F.bit_count(F.col(f"{k}{x}").bitwiseAND(F.bitwise_not(f"{k}{y}"))) for k in SIGNS])
    most = F.least("common", "common_a", F.col("size") - lost("", "_a"), F.col("size_a") - lost("_a", ""))
    return most >= similarity / (1 + similarity) * (F.col("size") + F.col("size_a")) - 1e-6


def link_components(members: DataFrame, sets: DataFrame, cuts: Cuts, similarity: float, linked: DataFrame) -> DataFrame | None:
    """(node, component) of linked nodes. members: (bucket, node, size, common, signature) of the buckets with several nodes.
    linked: (a, b), links there are already."""
    found, k = [linked], 0
    roots = None if linked.isEmpty() else cuts.write(components(linked, cuts))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    spread = members.join(sizes, "bucket").groupBy("node").agg(F.sum("m").alias("spread"))
    members = cuts.write(members.join(spread, "node"))
    now = members.withColumn("component", F.col("node"))
    if roots is not None:
        now = members.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    while True:
        # a bucket whose members are one component is done
        order = F.struct(-F.col("spread"), F.xxhash64("node"), "node")
        size = now.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(order).getField("node").alias("first"))
        drawn = F.expr(f"pmod(xxhash64(node, {k}), n) < {32**k}") if k else F.lit(False)
        now = cuts.write(now.join(size.where("lo <> hi").select("bucket", "n", "first"), "bucket").withColumn("leads", (F.col("node") == F.col("first")) | drawn).drop("n", "first"))
        if now.isEmpty():
            return roots
        leaders = now.where("leads").select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(k).alias(f"{k}_a") for k in ("size", "common", *SIGNS)])
        # of two leaders the smaller one meets the other
        met = now.join(leaders, "bucket").where("component <> ca and (not leads or node > a)").where(may_link(similarity))
        pairs = cuts.write(met.select("a", F.col("node").alias("b")).distinct())
        new = cuts.write(verified(pairs, sets, similarity))
        now = now.where("not leads").drop("leads")
        if not new.isEmpty():
            found.append(new)
            roots = cuts.write(components(reduce(DataFrame.union, found), cuts))
            now = now.drop("component").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
        k += 1


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, component_id) of documents with an id: the smallest doc_id reachable over links."""
    cuts = Cuts(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = cuts.write(nodes_of(docs))
    # copies collapse here
    unique = cuts.write(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("fp").alias("fp"), F.any_value("buckets").alias("buckets")))
    proposed = trie_pairs(unique.select("node", "fp"), cuts)
    every = unique.select("node", "rep", F.explode("buckets").alias("bucket"))
    shared = every.groupBy("bucket").count().where("count > 1").select("bucket", (F.col("count") >= DENSE).alias("dense"))
    members = cuts.write(every.join(cuts.write(shared), "bucket").select("bucket", "node", "rep", "dense"))
    either = proposed.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = cuts.write(members.select("node", "dense").union(either.withColumn("dense", F.lit(False))).groupBy("node").agg(F.max("dense").alias("dense")))
    ids = unique.join(nodes, "node").select(F.col("rep").alias("doc_id")).distinct()
    sets = cuts.write(sets_of(docs.join(ids, "doc_id", "left_semi")).join(nodes, "node"))
    linked = cuts.write(verified(proposed, sets, similarity))
    cuts.sweep()  # the trie's shuffles go before the buckets' come
    roots = link_components(able_members(members.drop("rep"), sets, cuts, similarity), sets, cuts, similarity, linked)
    if roots is not None:
        at = unique.select("node", "rep").join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = at.groupBy("component").agg(F.min("rep").alias("component_id"))
        led = at.join(least, "component").select("node", "component_id")
    else:
        led = unique.select("node", F.col("rep").alias("component_id"))
    out = cuts.write(rows.select("doc_id", "mark", "node").join(led, "node").select("doc_id", "mark", "component_id"))
    cuts.only(out)
    return out


def drop_similar(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Keeps of each group the rows whose doc_id is the group's smallest; rows with a null doc_id stay.

    A row goes by its own text's verdict, so other texts under the same doc_id are not touched.
    """
    rows, back = set_aside(docs, "doc_id", "text")
    drop = similar_groups(rows.select("doc_id", "text"), similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_gone")).distinct()
    marked = rows.withColumn("_mark", text_mark())
    return back(marked.join(drop, (marked["doc_id"] == drop["_id"]) & (marked["_mark"] == drop["_gone"]), "left_anti"))

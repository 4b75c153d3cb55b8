"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are the paths of a binary trie. Pairs of trie nodes are traversed together; the bits in which their paths
differ are counted, and a pair is pruned as soon as it exceeds the Hamming budget. The top levels are traversed by the
cluster: a fingerprint is dealt to the pairs of its own top node with the top nodes within the budget. A top node with
more than `leaf` fingerprints is descended further, and so are its pairs, until every node is a leaf. Below, each task
traverses its pair of subtrees over sorted arrays.

Defined results: a null or wordless text has fingerprint zero and links like any other; under three words the whole
word sequence is the only shingle; repeated shingles count each time; rows that share a doc_id give one row each; rows
with a null id link and bridge like others, and their component is null only if all its ids are; an empty table gives
no rows. Further columns, whatever their names, are not read; `drop_near_copies` keeps them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, byte_words, components, local_labels, set_aside, texts_of, typed_id

WIDTH, SEED, SHINGLE = 64, 42, 3
BLOCK = 1 << 16
#: Fingerprints of a trie node that one task may hold.
LEAF = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) and more: one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.drop(columns="text").assign(fp=np.fromiter(map(fingerprint, x["text"]), np.int64, len(x)))

    kept = "".join(f"{k} {docs.schema[k].dataType.simpleString()}, " for k in more)
    return typed_id(texts_of(docs, *more).mapInPandas(run, f"doc_id string, {kept}fp long"), docs)


def masks(depth: int, budget: int) -> list[int]:
    """Differences of two trie paths of this depth within the budget."""
    found = [0]
    if budget >= 1:
        found += [1 << i for i in range(depth)]
    if budget >= 2:
        found += [1 << i | 1 << j for i in range(depth) for j in range(i)]
    if budget > 2:
        found = [m for m in range(1 << depth) if m.bit_count() <= budget]
    return found


def trie_join(a: np.ndarray, b: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with popcount(a[i] ^ b[j]) <= budget; a and b: sorted uint64, each with one common path of `depth` bits.

    The frontier holds node pairs as ranges of the two arrays. It is a stack of blocks, so memory stays bounded.
    """
    if not len(a) or not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(depth, np.array([[0, len(a), 0, len(b)]], np.int64))]
    while stack:
        d, nodes = stack.pop()
        if len(nodes) > BLOCK:
            stack += [(d, nodes[BLOCK:])]
            nodes = nodes[:BLOCK]
        al, ah, bl, bh = nodes.T
        # small pairs of subtrees are leaves: their fingerprints are compared outright
        small = ((ah - al) * (bh - bl) <= 4) | (d >= WIDTH)
        if small.any():
            na, nb = (ah - al)[small], (bh - bl)[small]
            size = na * nb
            at = np.repeat(np.arange(len(size)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = al[small][at] + k // nb[at], bl[small][at] + k % nb[at]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            found.append((i[near], j[near]))
        if small.all():
            continue
        al, ah, bl, bh = (x[~small] for x in (al, ah, bl, bh))
        bit = np.uint64(1) << np.uint64(WIDTH - 1 - d)
        keep = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        am = np.clip(np.searchsorted(a, (a[al] & keep) | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] & keep) | bit), bl, bh)
        spent = np.bitwise_count((a[al] ^ b[bl]) & keep).astype(np.int64)
        children = []
        for x, y, cost in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            c = np.stack([(al, am)[x], (am, ah)[x], (bl, bm)[y], (bm, bh)[y]], axis=1)
            children.append(c[(c[:, 1] > c[:, 0]) & (c[:, 3] > c[:, 2]) & (spent + cost <= budget)])
        if len(new := np.concatenate(children)):
            stack.append((d + 1, new))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def node_at(fp, depth: int):
    """The trie node on the way to a fingerprint: its path behind a leading one."""
    return F.lit(1 << depth).bitwiseOR(F.shiftrightunsigned(fp, WIDTH - depth))


def each_mask(depth: int, budget: int):
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks(depth, budget)]))


def descend(pairs: DataFrame, node: str, heavy: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """pairs, where those at a heavy node of this depth are at its children within the budget of their own fingerprint."""
    at = pairs.join(heavy.select(F.col("node").alias("_node"), F.lit(True).alias("_heavy")), F.col(node) == F.col("_node"), "left").drop("_node")
    below = at.where("_heavy").withColumn("_m", each_mask(step, budget)).withColumn(node, F.shiftleft(node, step).bitwiseOR(node_at("fp", depth + step).bitwiseXOR(F.col("_m")).bitwiseAND((1 << step) - 1)))
    below = below.where(F.bit_count(F.col(node).bitwiseXOR(node_at("fp", depth + step))) <= budget)
    return at.where("_heavy is null").drop("_heavy").unionByName(below.drop("_m", "_heavy"))


def link_edges(unique: DataFrame, cuts: Cuts, budget: int = 2, leaf: int = LEAF, top: int = 8, step: int = 4) -> DataFrame:
    """(a, b): linked fingerprints, enough of them to connect whatever links. unique: (fp), one row per fingerprint."""
    n = unique.count()
    depth = max(top, math.ceil(math.log2(max(1, n / leaf))))
    rows = unique.select("fp", node_at("fp", depth).alias("own"))
    pairs = rows.withColumn("m", each_mask(depth, budget)).select("fp", "own", F.col("own").bitwiseXOR(F.col("m")).alias("other"))
    while depth + step < WIDTH - 1:
        counted = rows.where(F.col("own") >= F.lit(1 << depth)).groupBy(F.col("own").alias("node")).count()
        heavy = cuts.write(counted.where(F.col("count") > leaf).select("node"))
        if heavy.isEmpty():
            break
        rows = cuts.write(descend(rows, "own", heavy, depth, step, 0))
        pairs = cuts.write(descend(descend(pairs, "other", heavy, depth, step, budget), "own", heavy, depth, step, 0))
        depth += step
    there = cuts.write(rows.select(F.col("own").alias("other")).distinct())
    pairs = pairs.join(there, "other", "left_semi")
    pairs = pairs.select(F.least("own", "other").alias("k1"), F.greatest("own", "other").alias("k2"), (F.col("own") <= F.col("other")).alias("first"), "fp")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        k1, k2 = int(x["k1"].iloc[0]), int(x["k2"].iloc[0])
        u = x["fp"].to_numpy().astype(np.uint64)
        first = x["first"].to_numpy()
        one = np.sort(u[first])
        if k1 == k2:  # a node with itself
            two, both = one, one
        else:
            two = np.sort(u[~first])
            both = np.concatenate([one, two])
        i, j = trie_join(one, two, min(k1.bit_length(), k2.bit_length()) - 1, budget)
        label = local_labels(len(both), i, j if k1 == k2 else j + len(one))
        moved = label != np.arange(len(both))
        return pd.DataFrame({"a": both[moved].view(np.int64), "b": both[label[moved]].view(np.int64)})

    return cuts.write(pairs.groupBy("k1", "k2").applyInPandas(run, "a long, b long"))


def simhash_groups(docs: DataFrame, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of `budget` differing bits or fewer."""
    cuts = Cuts(docs.sparkSession)
    prints = cuts.write(fingerprints(docs))
    # copies collapse here: whatever follows sees each fingerprint once
    unique = cuts.write(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(link_edges(unique, cuts, budget, leaf), cuts).withColumnRenamed("node", "fp")
    grouped = cuts.write(unique.join(roots, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    byprint = cuts.write(grouped.join(least, "component").select("fp", "component_id"))
    cuts.only(prints, byprint)
    out = prints.join(byprint, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, budget: int = 2) -> DataFrame:
    """Keeps of each group the rows whose doc_id is the group's smallest; rows with a null doc_id stay.

    The verdicts of a repeated doc_id follow its rows' texts: a row stays if its own text's group is led by its doc_id.
    """
    rows, back = set_aside(docs, "doc_id", "text")
    groups = simhash_groups(rows, budget)
    gone = groups.where("doc_id <> component_id").select("doc_id", F.col("fingerprint").alias("_print")).distinct()
    # an id may have several texts: each row's verdict is found by its own text
    marked = rows.withColumn("_mark", F.xxhash64(F.coalesce(F.col("text"), F.lit("\x00"))))
    cuts = Cuts(docs.sparkSession)
    again = marked.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", "_mark")
    drop = cuts.write(fingerprints(again, "_mark").withColumn("_print", F.lpad(F.lower(F.hex("fp")), 16, "0")).join(gone, ["doc_id", "_print"], "left_semi").select("doc_id", "_mark").distinct())
    return back(marked.join(drop, ["doc_id", "_mark"], "left_anti"))

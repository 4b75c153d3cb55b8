"""Removal of long repeated strings by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. A transform of the whole corpus fits no
task, so texts are dealt by content first: of the grams inside each window of LENGTH bytes, the one with the least hash
(the last of equals) is its anchor, and equal windows have equal anchors. Consecutive windows with one anchor are a
piece of text. Pieces alike are one, with their number: they repeat as a whole. Pieces whose anchor occurs nowhere else
are done. The rest, where one anchor has several different pieces, are gathered by anchor in bounded buckets.

Words are dealt in the same way and beside them, as sequences of WORDS words that start anywhere else too, whatever stands
between their words: passages of over 50 words may have fewer than LENGTH bytes. They remove nothing and are counted.

An anchor with more than `hot` bytes of pieces would outgrow a bucket. Its pieces are cut into shorter ones, by where the
anchor lies in a window, and each gets a finer anchor: the bytes that all windows of its cut share. The same steps
follow, again and again with an eighth of the windows, until every anchor fits a bucket; a piece of one window has
nothing to be told apart from.

In a bucket a piece is left out if it shares with no other piece of its anchor what all windows of an eighth of their
places have in common, so none of its windows can be shared. The others are concatenated with unique ends, and their
transform is taken. Breadth-first backward extension
derives the common prefixes of neighbouring suffixes by increasing value: an interval of suffixes that share l bytes is
cut where they differ next, and each cut, extended to the left by every byte that stands before both sides, gives the
cuts at l + 1. Only the smaller sides are visited. At LENGTH it stops: what then still lies in one interval shares that
many bytes.

Pieces are told apart by 128 bits of hash, half of them their anchor's and half their own, by another base. Defined results: a null text is empty; texts shorter than LENGTH keep all;
rows alike in id and text are two texts that repeat each other; further columns, whatever their names, are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded_batches, texts_of, typed_id

LENGTH, GRAM = 400, 64
#: Of passages that are counted: words, and words of an anchor.
WORDS, WORD_GRAM = 51, 12
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BUCKET, HOT = 1 << 20, 1 << 20
#: Bytes of texts that are cut at once.
TOGETHER = 1 << 16
#: A hot anchor's pieces are cut to at most this share of their windows.
FINER = 8
U32 = np.uint64(0xFFFFFFFF)


@functools.lru_cache(8)
def powers(base: int, size: int) -> np.ndarray:
    x = np.full(size, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def power(base: int, n: int) -> np.ndarray:
    return powers(base % (1 << 64), max(1 << 16, 1 << n.bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


@functools.lru_cache(8)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Hashes:
    """Hashes of any ranges of a text's bytes or numbered words: polynomial prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(base, len(data)), out=self.sums[1:])
        self.inverse = power(inverse(base), len(data) + 1)

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    pad = np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def word_ranges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words (what stands between the six ASCII blanks) start and stop."""
    data = np.frombuffer(text, np.uint8)
    blank = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def hashed(text: bytes, words: bool) -> tuple[Hashes, Hashes]:
    data = np.frombuffer(text, np.uint8)
    both = [Hashes(data, base) for base in BASES]
    return tuple(by_word(both, *word_ranges(text)) if words else both)


def by_word(both: list[Hashes], start: np.ndarray, stop: np.ndarray) -> list[Hashes]:
    return [Hashes(x.of(start, stop), base) for x, base in zip(both, BASES, strict=True)]


def pieces(one: Hashes, two: Hashes, low: np.ndarray, high: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, stop, at, h, c) of each piece of the texts that lie in [low, high) of what is hashed.

    Windows start in [start, stop - length]; at, h: its anchor, c: its own hash.
    """
    n = len(one.sums) - 1
    window, text = spread(low, np.maximum(low, high - length + 1))
    if not len(window):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    g = one.of(slice(0, n - gram + 1), slice(gram, n + 1))
    key = (g & ~U32) | (U32 - np.arange(len(g), dtype=np.uint64))
    anchor = (U32 - (sliding_min(key, length - gram + 1)[window] & U32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    start, stop, at = window[first], window[np.append(first[1:], len(window)) - 1] + length, anchor[first]
    shape = mix((at - start).astype(np.uint64) * np.uint64(BASES[1]) + (stop - start).astype(np.uint64))
    return text[first], start, stop, at, g[at], mix(two.of(start, stop) ^ shape)


def both_pieces(texts: list[bytes], length: int, gram: int, words: int, word_gram: int) -> list[np.ndarray]:
    """(text, words, start, stop, at, h, c) of the pieces of some texts by bytes and by words, all placed by their text's bytes."""
    size = np.array([len(t) + 1 for t in texts])
    low, high = np.cumsum(size) - size, np.cumsum(size) - 1
    whole = b" ".join(texts)
    both = list(hashed(whole, False))
    a, b = word_ranges(whole)
    plain = pieces(*both, low, high, length, gram)
    text, start, stop, at, *keys = pieces(*by_word(both, a, b), np.searchsorted(a, low), np.searchsorted(a, high), words, word_gram)
    flag = np.repeat([False, True], [len(plain[0]), len(start)])
    text, start, stop, at, *keys = (np.concatenate(x) for x in zip(plain, (text, a[start], b[stop - 1], a[at], *keys), strict=True))
    return [text, flag, start - low[text], stop - low[text], at - low[text], *keys]


def by_size(texts: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in a row of some size together (a longer one alone), and where they start."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > size:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, texts[first:]


def finer(one: Hashes, two: Hashes, at: int, h: int, size: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(start, stop, h, c) of the shorter pieces of a piece with its anchor at `at`, of `size` windows at most.

    Windows are cut where the anchor's place in them is a multiple of size. The bytes common to all windows that such a
    cut can have are the finer anchor, whether the piece has all of them or not, so equal windows have equal ones.
    """
    place = at - np.arange(len(one.sums) - length)
    cut = place // size
    start = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1])))
    stop = np.concatenate((start[1:], [len(place)])) + length - 1
    cut = cut[start]
    inside = at - cut * size
    key = mix(one.of(inside, inside - size + 1 + length) ^ mix(cut.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(h % (1 << 64))))
    shape = mix((at - start).astype(np.uint64) * np.uint64(BASES[1]) + (stop - start).astype(np.uint64))
    return start, stop, key, mix(two.of(start, stop) ^ shape)


def suffix_order(t: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array (suffixes that share `depth` bytes in any order), by prefix doubling of what is left.

    t: values from 1 on (256 of bytes), 0 at the ends, which all differ.
    """
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    first = 63 // bits
    key = np.zeros(n, np.int64)
    for k in range(first):
        key = (key << bits) | np.pad(t[k:], (0, min(k, n))).astype(np.int64)
    # nothing behind a suffix's end counts
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    near = to_end < first
    key[near] &= ~((np.int64(1) << (bits * (first - 1 - to_end[near]))) - 1)
    sa = np.argsort(key)
    # equal ends, and what stands before them, follow the order of the texts
    slots = np.flatnonzero(near[sa])
    sa[slots] = sa[slots][np.lexsort((sa[slots], key[sa[slots]]))]
    key = key[sa]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | near[sa[1:]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = first
    while size < depth:
        tied = np.concatenate((~new[1:], [False])) | ~new
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = sa[slots]
        # a tied suffix has no end within `size`, so at + size is inside
        key = rank[at] * np.int64(n + 1) + rank[at + size]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        first = np.concatenate(([True], key[1:] != key[:-1]))
        new[slots] = first
        rank[at] = slots[np.flatnonzero(first)[np.cumsum(first) - 1]]
        size *= 2
    return sa


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which


def likely(data: np.ndarray, sizes: np.ndarray, at: np.ndarray, h: np.ndarray, length: int, gram: int, parts: int = 8) -> np.ndarray:
    """Which pieces may share a window with another one of their anchor h; data: all of them in a row, at: the anchor's place.

    Windows are told by the anchor's place in them, cut into parts. Those of a part have a string around the anchor in common.
    """
    first, whole, keep = np.cumsum(sizes) - sizes + at, Hashes(data, BASES[0]), np.zeros(len(sizes), bool)
    for places in np.array_split(np.arange(length - gram + 1), parts):
        if len(places):
            before, after = places[0], length - places[-1]
            has = np.flatnonzero((at >= before) & (at + after <= sizes))
            key = mix(whole.of(first[has] - before, first[has] + after) ^ mix(h[has]))
            _, which, n = np.unique(key, return_inverse=True, return_counts=True)
            keep[has[n[which] > 1]] = True
    return keep


def repeats(texts: list[bytes] | list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """Starts, in each text, of strings of this length that start at another place of the texts too. Texts: bytes, or numbers."""
    sizes = np.array([len(x) + 1 for x in texts])
    ends = np.cumsum(sizes) - 1
    if isinstance(texts[0], bytes):
        t = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int32) + 1
    else:
        t = np.concatenate([y for x in texts for y in (x, [0])]).astype(np.int32) + 1
    t[ends] = 0
    n = len(t)
    sa = suffix_order(t, ends, length)
    left = t[sa - 1]  # the transform; the first text's is an end too, as it should be
    extends = left > 0
    by = np.flatnonzero(extends)
    by = by[np.argsort(left[by], kind="stable")]
    # where a suffix goes when its left byte is put before it: the ends come first, then bytes in the transform's order
    lf = np.zeros(n, np.int32)
    lf[by] = len(ends) + np.arange(len(by))
    same = left[by[1:]] == left[by[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    head = t[sa]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    now = np.flatnonzero((head[1:] != head[:-1]) | (head[1:] == 0)) + 1
    seg, low, high, used = np.zeros(n, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), 1
    high[0] = n
    for _ in range(length):
        if not len(now):
            break
        cut[now] = True
        own = seg[now]
        # pieces of each interval: from its start or a cut to the next cut or its end
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ids, count = own[at], np.diff(np.append(at, len(own)))
        start = np.insert(now, at, low[ids])
        stop = np.append(start[1:], 0)
        last = at + np.arange(len(ids)) + count
        stop[last] = high[ids]
        turn = np.repeat(np.arange(len(ids)), count + 1)
        of = ids[turn]
        old_low, old_high = low[of], high[of]
        order = np.lexsort((start - stop, turn))
        largest = order[at + np.arange(len(ids))]
        small = np.ones(len(start), bool)
        small[largest] = False
        name = of.copy()
        name[small] = used + np.arange(small.sum())
        used += int(small.sum())
        low[name], high[name] = start, stop
        e, which = spread(start[small], stop[small])
        seg[e] = name[small][which]
        floor, ceiling = old_low[small][which], old_high[small][which]
        b, a = before[e], after[e]
        back = (b >= floor) & (seg[np.maximum(b, 0)] != seg[e])
        forth = (a < ceiling) & (seg[np.minimum(a, n - 1)] != seg[e])
        now = np.unique(np.concatenate([lf[e[back]], lf[a[forth]]]))
        now = now[~cut[now]]
    shared = np.sort(sa[(high - low)[seg] > 1])
    first = ends - sizes + 1
    return [shared[i:j] - s for i, j, s in zip(np.searchsorted(shared, first), np.searchsorted(shared, ends), first, strict=True)]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The starts' strings as merged [start, stop) ranges."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate(([0], gap))].tolist(), (starts[np.concatenate((gap - 1, [len(starts) - 1]))] + length).tolist(), strict=True))


def keyed(docs: DataFrame) -> DataFrame:
    return texts_of(docs.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("mark", F.xxhash64("text"))


SPAN = "doc_id string, mark long, words boolean, start long, stop long"
PIECE = SPAN + ", at long, n long, h long"
KIND = ["words", "h", "c"]


def told_apart(rows: DataFrame, cuts: Cuts, hot: int, *more: str) -> tuple[DataFrame, DataFrame, int]:
    """What repeats as a whole (SPAN); one of each kind of the pieces that may repeat in part, and their bytes but for hot ones.

    rows: PIECE, c and more. n: how many pieces a row stands for.
    """
    one = F.min(F.struct("doc_id", "mark", "start", "stop", "at", *more)).alias("one")
    kinds = cuts.write(rows.groupBy(*KIND).agg(F.sum("n").alias("n"), one))
    cuts.sweep()
    whole = cuts.write(rows.where("n = 1").join(kinds.where("n > 1").select(*KIND), KIND, "left_semi").select("doc_id", "mark", "words", "start", "stop"))
    cuts.sweep()
    # anchors with different pieces, at least one of which is alone
    size = F.sum(F.col("one.stop") - F.col("one.start"))
    anchors = kinds.groupBy("words", "h").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), size.alias("bytes")).where("kinds > 1 and least = 1")
    anchors = cuts.write(anchors.select("words", "h", "bytes", (F.col("bytes") > hot).alias("hot")))
    fits = anchors.where("not hot").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return whole, kinds.join(anchors.select("words", "h", "hot"), ["words", "h"]).select("one.*", "n", "words", "h", "hot"), fits


def shared(x: pd.DataFrame, words: bool, length: int, gram: int) -> list[tuple[int, int, int]]:
    """(row, start, stop) of what a bucket's pieces share, a piece a row."""
    at = (x["at"] - x["start"]).to_numpy()
    if words:
        texts = [p.split() for p in x["piece"]]
        sizes, data = np.array([len(t) for t in texts]), pd.factorize(np.array([w for t in texts for w in t], object))[0]
        at = np.array([len(p[:k].split()) for p, k in zip(x["piece"], at, strict=True)])
        texts = np.split(data, np.cumsum(sizes)[:-1])
    else:
        texts = x["piece"].tolist()
        sizes, data = np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8)
    rows = np.flatnonzero(likely(data, sizes, at, x["h"].to_numpy().astype(np.uint64), length, gram))
    made = []
    for i, found in zip(rows.tolist(), repeats([texts[i] for i in rows], length) if len(rows) else [], strict=True):
        if x["n"].iat[i] == 1 and len(found):
            first = x["start"].iat[i]
            if words:
                starts, stops = word_ranges(x["piece"].iat[i])
                made += [(i, first + int(starts[a]), first + int(stops[b - 1])) for a, b in runs(found, length)]
            else:
                made += [(i, first + a, first + b) for a, b in runs(found, length)]
    return made


def repeated_spans(
    docs: DataFrame, cuts: Cuts, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, hot: int = HOT, words: int = WORDS, word_gram: int = WORD_GRAM
) -> DataFrame:
    """(doc_id, mark, words, start, stop): ranges of bytes that go or, with words, whose words are counted; they may overlap."""
    rows = keyed(docs)
    units = {False: (length, gram), True: (words, word_gram)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = []
            for first, texts in by_size([t.encode() for t in x["text"]], TOGETHER):
                text, *more = both_pieces(texts, length, gram, words, word_gram)
                made.append([text + first, *more])
            if made:
                text, flag, *more = map(np.concatenate, zip(*made, strict=True))
                out = {k: v.astype(np.int64) for k, v in zip(("start", "stop", "at", "h", "c"), more, strict=True)}
                yield pd.DataFrame({"doc_id": x["doc_id"].iloc[text].reset_index(drop=True), "mark": x["mark"].to_numpy()[text], "words": flag, "n": 1} | out)

    long = rows.where(F.octet_length("text") >= min(length, 2 * words - 1))
    every = cuts.write(long.mapInPandas(cut, PIECE + ", c long"))
    whole, left, total = told_apart(every, cuts, hot)
    spans = [whole]
    lists = left.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "n", "hot", "words", "at", "start", "stop")).alias("wanted"))
    lists = cuts.write(lists.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}))
    # texts are shuffled next, so what was before must not lie beside them
    cuts.only(whole, lists)
    held = long.join(lists, long["doc_id"].eqNullSafe(lists["_id"]) & (long["mark"] == lists["_mark"])).drop("_id", "_mark").dropDuplicates(["doc_id", "mark"])
    names = ["doc_id", "mark", "words", "start", "stop", "at", "n", "h", "hot", "piece"]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made, size = [], 0
            for doc_id, mark, text, want in zip(x["doc_id"], x["mark"], x["text"], x["wanted"], strict=True):
                data = text.encode()
                for w in want:
                    made.append((doc_id, mark, w["words"], w["start"], w["stop"], w["at"], w["n"], w["h"], w["hot"], data[w["start"] : w["stop"]]))
                    size += w["stop"] - w["start"]
                    if size > 1 << 22:
                        yield pd.DataFrame(made, columns=names)
                        made, size = [], 0
            yield pd.DataFrame(made, columns=names)

    held = cuts.write(held.mapInPandas(take, PIECE + ", hot boolean, piece binary"))
    cuts.sweep()
    fitting, sizes = [held.where("not hot")], {unit: a - b + 1 for unit, (a, b) in units.items()}

    def shorten(batches: Iterator[pd.DataFrame], sizes: dict[bool, int]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = []
            for doc_id, mark, unit, start, at, n, h, piece in zip(x["doc_id"], x["mark"], x["words"], x["start"], x["at"], x["n"], x["h"], x["piece"], strict=True):
                own = at - start
                first = np.arange(len(piece) + 1)
                last = first[1:]
                if unit:
                    first, last = word_ranges(piece)
                    own = int(np.searchsorted(first, own))
                for a, b, *keys in zip(*(k.astype(np.int64).tolist() for k in finer(*hashed(piece, unit), own, h, sizes[unit], units[unit][0])), strict=True):
                    a, b = int(first[a]), int(last[b - 1])
                    made.append((doc_id, mark, unit, start + a, start + b, at, n, *keys, piece[a:b]))
            yield pd.DataFrame(made, columns=["doc_id", "mark", "words", "start", "stop", "at", "n", "h", "c", "piece"])

    while max(sizes.values()) > 1 and not (now := held.where("hot")).isEmpty():
        sizes = {unit: -(-size // FINER) for unit, size in sizes.items()}
        shorter = cuts.write(now.mapInPandas(functools.partial(shorten, sizes=sizes), PIECE + ", c long, piece binary"))
        whole, left, fits = told_apart(shorter, cuts, hot, "piece")
        spans.append(whole)
        held = cuts.write(left.select(*names))
        fitting.append(held.where("not hot"))
        total += fits
    # of one window at last: what hashes alike is alike
    fitting.append(held.where("hot"))
    buckets = max(1, -(-total // bucket))

    def expand(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["h", "start"], ignore_index=True)
        unit = bool(x["words"].iat[0])
        made = shared(x, unit, *units[unit])
        at = [m[0] for m in made]
        out = {"mark": x["mark"].to_numpy()[at], "words": unit, "start": np.array([m[1] for m in made], np.int64), "stop": np.array([m[2] for m in made], np.int64)}
        return pd.DataFrame({"doc_id": x["doc_id"].iloc[at].reset_index(drop=True)} | out)

    gathered = functools.reduce(DataFrame.union, fitting).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    spans.append(cuts.write(gathered.groupBy("words", "bucket").applyInPandas(lambda x: expand(x), SPAN)))
    cuts.only(*spans)
    return functools.reduce(DataFrame.union, spans)


def merged(spans, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def with_spans(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """doc_id (a string), text (null: empty) and spans, an array of ranges (null: none): to remove or, with words, to count words in. A row for each row of docs."""
    bounded_batches(docs.sparkSession)
    spans = repeated_spans(docs, Cuts(docs.sparkSession), length, **limits)
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("words", "start", "stop")).alias("spans")).withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    rows = keyed(docs)
    return rows.join(lists, rows["doc_id"].eqNullSafe(lists["_id"]) & (rows["mark"] == lists["_mark"]), "left").select("doc_id", "text", "spans")


def removed(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words (those in sequences of WORDS words that also start
    elsewhere), kept (the bytes that stay)."""
    found = with_spans(docs, length, **limits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            made = []
            for text, spans in zip(x["text"], x["spans"], strict=True):
                data = text.encode()
                gone, told = (merged((s for s in (() if spans is None else spans) if s["words"] == unit), len(data)) for unit in (False, True))
                at = [0, *(y for r in gone for y in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                made.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(len(data[a:b].split()) for a, b in told), kept))
            yield pd.concat([x[["doc_id"]].reset_index(drop=True), pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words", "kept"])], axis=1)

    return typed_id(found.mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long, kept binary"), docs)

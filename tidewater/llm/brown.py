"""Language-model scoring with Brown class-based bigrams.

P(word | previous) = P(class of word | class of previous) * P(word | class of word). Exchange clustering assigns every
training word to a class, in two parts that are bounded in different ways:

* Words of at least `own` of all tokens (1 / own of them at most) are exchanged against each other: their bigrams are
  counted once, each round counts every word's neighbours by class, and words move to the class that raises the
  likelihood of class bigrams most. A round's moves count only if the likelihood has risen; else fewer words move.
* All other words, however many the corpus has, stay a distributed table: a row holds a word's count and how often it
  follows each class of frequent words. A round assigns every word to the class under which what it follows is likeliest,
  then counts anew; the driver gets class by class counts. As no word's row depends on another word's class, all words
  move at once and the likelihood never falls. Rounds end when it no longer rises.

As history, the words of the second part count as one class, the tail. Transitions are interpolated with the classes'
shares. Emissions are discounted absolutely, and what the discount frees goes to the class's unknown word, so each
distribution sums to one; a word that training doesn't have is the unknown word of any class.

Defined results: a null text is empty and has one token, its end; the end is a class and a word of its own that no text
can spell; rows with a null id train; with no training text every probability is that of an unseen word; each row is
scored by itself, repeated or not; further columns, whatever their names, are not read; an empty table gives no rows. Words are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded_batches, texts_of, typed_id
from tidewater.llm.tokens import Lookup, hashed_words, lists, with_ends

#: Which texts are held out: crc32 of the id as text, modulo FOLDS, is HELD.
FOLDS, HELD = 7, 2
#: Tokens whose pairs a worker counts at once.
CHUNK = 1 << 22


@dataclass(frozen=True)
class Settings:
    classes: int = 48
    rounds: int = 60  # a guard: rounds end when the likelihood rises by less than the tolerance
    own: float = 2e-5
    common: float = 1e-6
    tolerance: float = 1e-4

    def __post_init__(self) -> None:
        if not 2 <= self.classes <= 254:  # with the tail a class is a byte
            raise ValueError("classes must be from 2 to 254")


def fold(docs: DataFrame) -> DataFrame:
    """doc_id (a string), text, held_out."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return texts_of(docs, (F.pmod(crc, F.lit(FOLDS)) == HELD).alias("held_out"))


def count_words(train: DataFrame) -> DataFrame:
    """(h, c) of all words of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

        for x in batches:
            held.append(hashed_words(x.column(0))[0])
            size += len(held[-1])
            if size > CHUNK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def count_bigrams(train: DataFrame, table, units: int) -> DataFrame:
    """(a, b, c): how often unit b follows unit a. Unit 0 is the end, the last one the tail; a text begins after an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, keys, size = Lookup(table.value), [], 0

        def out() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(keys), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k // units), pa.array(k % units), pa.array(c)], ["a", "b", "c"])

        for x in batches:
            h, counts = hashed_words(x.column(0))
            at = find(h)
            u, _ = with_ends(np.where(at < 0, units - 1, at + 1), counts, 0)
            keys.append(np.concatenate(([0], u[:-1])) * units + u)
            size += len(u)
            if size > CHUNK:
                yield out()
                keys, size = [], 0
        if keys:
            yield out()

    return train.select("text").mapInArrow(run, "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))


def neighbours(bigrams: DataFrame, group: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit stands before, and after, a word of each class: two tables of units x classes."""
    total = len(group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = np.zeros(2 * total * classes, np.int64)
        for x in batches:
            a, b, c = (x[k].to_numpy() for k in "abc")
            np.add.at(made, a * classes + group[b], c)
            np.add.at(made, total * classes + b * classes + group[a], c)
        at = np.flatnonzero(made)
        yield pd.DataFrame({"at": at, "c": made[at]})

    rows = bigrams.mapInPandas(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # bounded by units x classes
    made = np.zeros(2 * total * classes)
    made[rows["at"].to_numpy(np.int64)] = rows["c"]
    return made[: total * classes].reshape(total, classes), made[total * classes :].reshape(total, classes)


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_counts(right: np.ndarray, group: np.ndarray, classes: int) -> np.ndarray:
    made = np.zeros((classes, classes))
    np.add.at(made, group, right)
    return made


def likelihood(counts: np.ndarray) -> float:
    """Of class bigrams, but for what no exchange changes."""
    return float(phi(counts).sum() - phi(counts.sum(axis=0)).sum() - phi(counts.sum(axis=1)).sum())


def gains(u: int, group: np.ndarray, counts: np.ndarray, right: np.ndarray, left: np.ndarray, itself: float = 0.0) -> np.ndarray:
    """What the likelihood of class bigrams gains if unit u, taken out, joins each class. itself: how often u follows u."""
    g, r, before = group[u], right[u].copy(), left[u].copy()
    r[g] -= itself
    before[g] -= itself
    n = counts.copy()
    n[g] -= r
    n[:, g] -= before
    n[g, g] -= itself
    # wherever u goes, its neighbours' classes keep their margins
    rows, columns = n.sum(axis=1) + before, n.sum(axis=0) + r
    ends = phi(rows + r.sum() + itself) - phi(rows) + phi(columns + before.sum() + itself) - phi(columns)
    # a class's own cell gets both
    own = n.diagonal()
    both = phi(own + r + before + itself) - phi(own + r) - phi(own + before) + phi(own)
    return (phi(n + r) - phi(n)).sum(axis=1) + (phi(n + before[:, None]) - phi(n)).sum(axis=0) + both - ends


def exchange(bigrams: DataFrame, sizes: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, the class bigram counts, and the likelihood after each round.

    The end keeps class 0 to itself, and the tail the last one, s.classes. Moves are sought against frozen counts, so
    that moves at once may spoil each other: a round that doesn't raise the likelihood is tried with half of its moves.
    """
    total = s.classes + 1
    order = np.argsort(-sizes[1:-1], kind="stable") + 1
    group = np.zeros(len(sizes), np.int64)
    group[order], group[-1] = 1 + np.arange(len(order)) % (s.classes - 1), s.classes
    right, left = neighbours(bigrams, group, total)
    counts, itself = class_counts(right, group, total), np.zeros(len(sizes))
    for row in bigrams.where("a = b").collect():  # a row per unit
        itself[row["a"]] = row["c"]
    risen, share, tried = [likelihood(counts)], 2, 0
    for _ in range(s.rounds):
        best, gained = group.copy(), np.zeros(len(group))
        for u in order:
            if right[u].any() or left[u].any():
                gain = gains(u, group, counts, right, left, itself[u])[1:-1]
                best[u], gained[u] = 1 + int(gain.argmax()), gain.max() - gain[group[u] - 1]
        moves = np.flatnonzero(gained > 1e-9 * abs(risen[-1]))
        moves = moves[np.argsort(-gained[moves], kind="stable")]
        share, tried = max(2, share // 2) if tried == 1 else share, 0
        while len(moves):
            tried += 1
            some, new = moves[: max(1, len(moves) // share)], group.copy()
            new[some] = best[some]
            new_right, new_left = neighbours(bigrams, new, total)
            new_counts = class_counts(new_right, new, total)
            if (now := likelihood(new_counts)) > risen[-1]:
                break
            # the best move alone is what its gain says
            moves, share = moves if len(some) > 1 else some[:0], 2 * share
        if not len(moves):
            break
        group, right, left, counts = new, new_right, new_left, new_counts
        risen.append(now)
        if risen[-1] - risen[-2] < s.tolerance * abs(risen[-1]):
            break
    return group, counts, risen


def count_contexts(train: DataFrame, table, tail: int) -> DataFrame:
    """(h, c, cells) of all words but the frequent ones. A cell is how often the word follows a class, times 256, plus the class.

    table: hashes of the frequent words and their classes. Partial rows are merged in the order of their hashes, as a
    stream: a worker holds one batch, and a hot word has a row for each chunk of the corpus at most.
    """
    width = tail + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group = table.value
        find, held, size = Lookup(hashes), [], 0

        def out() -> pa.RecordBatch:
            h, before = (np.concatenate(x) for x in zip(*held, strict=True))
            words, at = np.unique(h, return_inverse=True)
            key, c = np.unique(at * width + before, return_counts=True)
            return packed(words, key // width, key % width, c)

        for x in batches:
            h, counts = hashed_words(x.column(0))
            at = find(h)
            kind, _ = with_ends(np.where(at < 0, tail, group[at] if len(group) else tail), counts, 0)
            kind = np.concatenate(([0], kind[:-1]))[: len(kind)]
            inside, _ = with_ends(h, counts, 0)
            rare, _ = with_ends(at < 0, counts, False)
            held.append((inside[rare], kind[rare]))
            size += len(held[-1][0])
            if size > CHUNK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def packed(words: np.ndarray, word: np.ndarray, kind: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        """word: the place in words of each cell, ascending."""
        total = np.bincount(word, weights=c, minlength=len(words)).astype(np.int64)
        cells = lists(c.astype(np.int64) * 256 + kind, np.searchsorted(word, np.arange(len(words) + 1)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(total), cells], ["h", "c", "cells"])

    def dense(words: np.ndarray, made: np.ndarray) -> pa.RecordBatch:
        word, kind = np.nonzero(made)
        return packed(words, word, kind, made[word, kind])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None
        for x in batches:
            if not x.num_rows:
                continue
            words, at = np.unique(x.column(0).to_numpy(), return_inverse=True)
            made = histograms(x.column(1), at, len(words), width)
            if last is not None:
                if last[0][0] == words[0]:
                    made[0] += last[1][0]
                else:
                    yield dense(*last)
            if len(words) > 1:
                yield dense(words[:-1], made[:-1])
            last = words[-1:], made[-1:]
        if last is not None:
            yield dense(*last)

    kind = "h long, c long, cells array<long>"
    parts = train.select("text").mapInArrow(run, kind).select("h", "cells")
    return parts.repartition("h").sortWithinPartitions("h").mapInArrow(merge, kind)


def histograms(cells: pa.ListArray, at: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Counts by row and class; at: the row that each list belongs to."""
    flat = cells.flatten().to_numpy()
    size = np.diff(cells.offsets.to_numpy())
    key = np.repeat(at, size) * width + flat % 256
    return np.bincount(key, weights=flat // 256, minlength=rows * width).reshape(rows, width)


def likely(counts: np.ndarray) -> np.ndarray:
    """log P(class before | class): counts by class before, class."""
    x = counts + 1e-6
    return np.log(x / x.sum(axis=0))


def assigned(words: DataFrame, weights: np.ndarray, width: int, more: str = "") -> DataFrame:
    """(h, c, class) of the words, or, with more = "sum", (at, c): the assigned words' counts by class before and class."""
    classes = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * classes)
        for x in batches:
            made = histograms(x.column(2), np.arange(x.num_rows), x.num_rows, width)
            best = 1 + (made @ weights[:, 1:]).argmax(axis=1)
            if more:
                for k in range(1, classes):
                    sums.reshape(width, classes)[:, k] += made[best == k].sum(axis=0)
            else:
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(best.astype(np.int32))], ["h", "c", "class"])
        if more:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at].astype(np.int64))], ["at", "c"])

    return words.mapInArrow(run, "at long, c long" if more else "h long, c long, class int")


def settle(words: DataFrame, start: np.ndarray, s: Settings, cuts: Cuts) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(h, c, class) of the words, all words' counts by class before and class, and the likelihood after each round.

    start: the frequent words' counts by class before and class.
    """
    width = s.classes + 1
    weights, risen = likely(start + 0.5), []
    while True:
        rows = assigned(words, weights, width, "sum").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # class by class
        added = np.zeros(start.size)
        added[rows["at"].to_numpy(np.int64)] = rows["c"]
        counts = start + added.reshape(start.shape)
        risen.append(float(phi(counts).sum() - phi(counts.sum(axis=0)).sum()))
        if len(risen) >= s.rounds or (len(risen) > 1 and risen[-1] - risen[-2] <= s.tolerance * abs(risen[-1])):
            break
        weights = likely(counts)
    return cuts.write(assigned(words, weights, width)), counts, risen


@dataclass
class Model:
    """What the workers need to score a text but for the words that aren't common."""

    hashes: np.ndarray  # common words, ascending
    counts: np.ndarray
    group: np.ndarray  # their classes
    before: np.ndarray  # what they are as history: their class if they are frequent, else the tail
    tokens: int
    words: int
    ends: int
    moves: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of the emissions' denominators by class
    spare: np.ndarray  # the emissions' numerators of unknown words by class
    discount: float
    risen: list[list[float]] = field(default_factory=list)

    @property
    def unknown(self) -> np.ndarray:
        """log10 P(unknown word | class before)."""
        return np.log10((10**self.moves * (self.spare / 10**self.room)).sum(axis=1))


def fit(docs: DataFrame, s: Settings, cuts: Cuts) -> tuple[DataFrame, Model]:
    """(h, c, class) of all training words, and the model."""
    train, context = docs.where("not held_out"), cuts.spark.sparkContext
    once = F.count(F.when(F.col("c") == 1, 1))
    twice = F.count(F.when(F.col("c") == 2, 1))
    counted = cuts.write(count_words(train))
    ends = train.count()
    n, v, ones, twos = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), once, twice).first()
    discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
    n, v = n + ends, v + (ends > 0)
    # at most 1 / own words
    top = counted.where(F.col("c") >= max(2.0, s.own * n)).toPandas().sort_values("h")
    cuts.drop(counted)
    hashes, freq = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    units = len(hashes) + 2
    bigrams = cuts.write(count_bigrams(train, context.broadcast(hashes), units))
    group, pairs, risen = exchange(bigrams, np.concatenate(([ends], freq, [0])), s)
    kinds = group[1:-1]
    tail = count_contexts(train, context.broadcast((hashes, kinds)), s.classes)
    words, counts, settled = settle(cuts.write(tail), pairs[:, : s.classes], s, cuts)
    every = words.union(cuts.spark.createDataFrame(pd.DataFrame({"h": hashes, "c": freq, "class": kinds.astype(np.int32)}), words.schema)) if len(hashes) else words
    # distinct words of each class, for the emissions' smoothing
    number = np.zeros(s.classes)
    for row in every.groupBy("class").agg(F.count("*").alias("n")).collect():
        number[row["class"]] = row["n"]
    number[0] = 1
    mass = counts.sum(axis=0)
    share = (mass + 1) / (mass + 1).sum()
    moves = np.log10((counts + s.classes * share) / (counts.sum(axis=1, keepdims=True) + s.classes))
    # (c - discount) of known words, discount * kinds of the unknown one, and half a count so that none is zero
    room, spare = np.log10(mass + 0.5), discount * np.where(mass > 0, number, 0) + 0.5
    # at most 1 / common words
    common = every.where(F.col("c") >= max(2.0, s.common * n)).toPandas().sort_values("h")
    kind = common["class"].to_numpy(np.int64)
    known = common["h"].to_numpy(np.int64)
    before = np.where(Lookup(hashes)(known) >= 0, kind, s.classes)
    return every, Model(known, common["c"].to_numpy(np.int64), kind, before, int(n), int(v), ends, moves, room, spare, discount, [risen, settled])


def score(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    s, spark, cuts = s or Settings(), docs.sparkSession, Cuts(docs.sparkSession)
    bounded_batches(spark, rows=10_000)
    rows = fold(docs)
    counts, fitted = fit(rows, s, cuts)
    model = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        find, part, done, width = Lookup(m.hashes), TaskContext.get().partitionId() << 36, 0, len(m.moves)
        # the end stands behind the common words, what isn't common behind it
        group = np.concatenate((m.group, [0, 0]))
        before = np.concatenate((m.before, [0, width - 1]))
        base = np.log10(np.concatenate((m.counts + 1.0, [m.ends + 1.0, 1.0])))
        own = np.log10(np.concatenate((m.counts - m.discount, [m.ends - m.discount if m.ends else m.spare[0], 1.0]))) - m.room[group]
        end, other = len(m.hashes), len(m.hashes) + 1
        for x in batches:
            h, size = hashed_words(x.column(1))
            at = find(h)
            code, row = with_ends(np.where(at < 0, other, at), size, end)
            word, _ = with_ends(h, size, 0)
            last = np.concatenate(([0], before[code[:-1]]))[: len(code)]
            rare = code == other
            n = x.num_rows
            summed = lambda v: np.bincount(row[~rare], weights=v[~rare], minlength=n)
            word, kind, text = word[rare], last[rare], row[rare]
            order = np.lexsort((kind, word, text))
            word, kind, text = word[order], kind[order], text[order]
            new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (kind[1:] != kind[:-1]) | (text[1:] != text[:-1])))) if len(word) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(word)))
            cut = np.searchsorted(text[new], np.arange(n + 1))
            made = {
                "row": pa.array((part | done) + np.arange(n)),
                "doc_id": x.column(0),
                "held_out": x.column(2),
                "n_tokens": pa.array(size + 1),
                "n_known": pa.array(size + int(m.ends > 0) - np.bincount(row[rare], minlength=n)),
                "base": pa.array(summed(base[code])),
                "own": pa.array(summed(m.moves[last, group[code]] + own[code])),
                "rare": lists(word[new], cut, pa.int64()),
                "before": lists(kind[new], cut, pa.int32()),
                "times": lists(times, cut, pa.int32()),
            }
            done += n
            yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    half = cuts.write(rows.mapInArrow(run, "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base double, own double, rare array<long>, before array<int>, times array<int>"))
    rare = half.select("row", F.explode(F.arrays_zip("rare", "before", "times")).alias("z")).select("row", F.col("z.rare").alias("h"), "z.before", "z.times")
    rare = rare.join(counts, "h", "left").withColumns({"class": F.coalesce("class", F.lit(-1)), "c": F.coalesce("c", F.lit(0))})
    steps = [(b, k, float(fitted.moves[b, k] - fitted.room[k])) for b in range(s.classes + 1) for k in range(s.classes)]
    steps += [(b, -1, float(x)) for b, x in enumerate(fitted.unknown)]
    step = F.broadcast(spark.createDataFrame(steps, "before int, class int, step double"))  # class by class
    known = F.when(F.col("c") > 0, F.log10(F.col("c") - F.lit(fitted.discount))).otherwise(0.0)
    rare = rare.join(step, ["before", "class"]).groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("rare_base"),
        F.sum(F.col("times") * (F.col("step") + known)).alias("rare_own"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    out = typed_id(half.drop("rare", "before", "times"), docs).join(rare, "row", "left")
    space = float(np.log10(fitted.tokens + fitted.words + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(fitted.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"),
        (F.col("own") + F.coalesce("rare_own", F.lit(0.0))).alias("score"),
    )

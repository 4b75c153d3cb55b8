"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. A trigram's vector binds its letters: the product of
the first letter's vector, the second's permuted by one place and the third's permuted by two. A text's vector bundles
(sums) the vectors of its trigrams, a language's prototype those of its training texts; each text gets the language whose
prototype has the largest cosine with it.

Trigrams are those of words between blanks: letters are lower-cased one by one, everything else is a blank. Training
counts trigrams by language in tasks and adds counts up in a shuffle, so a hot language or source costs a task no more
than any other; vectors are made from the counts. Prototypes reach workers BLOCK languages at a time, and texts keep the
best of all blocks, so neither the driver nor a worker holds more, however many values the language column has.

Only texts and languages of training rows are learned from; language, source and id are no inputs of a prediction.

Defined results: a null text, a text without letters, and any text where nothing was learned is `und` with score 0; a
null language teaches nothing; a null id counts as an empty one; a language without letters is not learned; equal cosines
go to the smallest language; a negative cosine is score 0; a text is cut into slices of SLICE characters, over which its
trigrams run on; repeated rows are scored each by itself; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded, texts_of, typed_id

#: Which texts are held out: crc32 of the id as text, modulo FOLDS, is HELD.
FOLDS, HELD = 4, 2
DIMS, SEED = 1024, 20_260_101
#: Languages whose prototypes a worker holds at once, characters of a text it looks at, trigram vectors it keeps.
BLOCK, SLICE, KEPT = 256, 1 << 20, 1 << 15
BITS = 21


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of a text, three letters in a number, and how often each occurs."""
    held, counts, before = [], [], np.zeros(1, np.int64)
    for s in range(0, len(text), SLICE):
        x = letters()[np.frombuffer(text[s : s + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        x = np.concatenate((before, x) if s + SLICE < len(text) else (before, x, [0]))
        blank = x == 0
        x = x[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        grams = (x[:-2] << 2 * BITS | x[1:-1] << BITS | x[2:])[x[1:-1] != 0]
        before = x[-2:]
        for a, b in zip((held, counts), np.unique(grams, return_counts=True), strict=True):
            a.append(b)
    if len(held) == 1:
        return held[0], counts[0]
    return added(held, counts)


def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


class Vectors:
    """Vectors of trigrams; some are kept for the next text."""

    def __init__(self):
        self.letter: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.known, self.row, self.made = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, DIMS), np.float32)

    def of_letter(self, c: int) -> np.ndarray:
        if c not in self.letter:
            raw = np.random.Philox(key=[SEED, c]).random_raw(DIMS // 64)
            self.letter[c] = np.unpackbits(raw.astype("<u8").view(np.uint8)).astype(np.float32) * 2 - 1
        return self.letter[c]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        mask, out = (1 << BITS) - 1, np.ones((len(grams), DIMS), np.float32)
        for place in range(3):
            each, at = np.unique(grams >> (2 - place) * BITS & mask, return_inverse=True)
            out *= np.stack([np.roll(self.of_letter(int(c)), place) for c in each])[at]
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors. grams: distinct."""
        if len(grams) > KEPT // 4:
            return sum(counts[s : s + 4096].astype(np.float64) @ self.bind(grams[s : s + 4096]) for s in range(0, len(grams), 4096))
        at = np.searchsorted(self.known, grams)
        new = grams[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != grams)] if len(self.known) else grams
        if len(new):
            if len(self.made) + len(new) > KEPT:
                self.clear()
                new = grams
            self.made, n = np.concatenate([self.made, self.bind(new)]), len(self.made)
            known, row = np.concatenate([self.known, new]), np.concatenate([self.row, np.arange(n, n + len(new))])
            order = np.argsort(known)
            self.known, self.row = known[order], row[order]
            at = np.searchsorted(self.known, grams)
        return (counts.astype(np.float32) @ self.made[self.row[at]]).astype(np.float64)


def fold(docs: DataFrame) -> DataFrame:
    """doc_id (a string), text, held_out, lang."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return texts_of(docs, (crc % FOLDS == HELD).alias("held_out"), F.col("lang").cast("string").alias("lang"))


def profiles(train: DataFrame) -> DataFrame:
    """(lang, gram, n) of the training texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (grams, counts) in held.items():
                g, n = added(grams, counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

        for x in batches:
            for lang, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                g, n = trigrams(text)
                grams, counts = held.setdefault(lang, ([], []))
                grams.append(g)
                counts.append(n)
                size += len(g)
            if size > 1 << 21:
                yield from out()
                held, size = {}, 0
        yield from out()

    rows = train.where("lang is not null and text is not null and text <> ''").select("lang", "text")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counted: DataFrame) -> DataFrame:
    """(lang, place, x): each language's bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(), {}

        def out() -> pa.RecordBatch:
            langs = list(sums)
            whole = np.concatenate([sums[k] for k in langs])
            return pa.RecordBatch.from_arrays([pa.array([k for k in langs for _ in range(DIMS)], pa.string()), pa.array(np.tile(np.arange(DIMS, dtype=np.int32), len(langs))), pa.array(whole)], ["lang", "place", "x"])

        for x in batches:
            lang, gram, n = np.array(x.column(0).to_pylist(), object), x.column(1).to_numpy(), x.column(2).to_numpy()
            order = np.argsort(lang, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], lang[order][1:] != lang[order][:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for s in range(a, b, KEPT // 4):
                    part = order[s : min(b, s + KEPT // 4)]
                    made = vectors.bundle(gram[part], n[part])
                    sums[lang[part[0]]] = sums.get(lang[part[0]], 0) + made
                if len(sums) >= BLOCK:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    return counted.mapInArrow(run, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))


def _scored(rows: DataFrame, langs: list[str], unit: np.ndarray) -> DataFrame:
    """rows (doc_id, text, held_out, lang_pred, score), each with the best of its own and these languages'."""
    shared = rows.sparkSession.sparkContext.broadcast((langs, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, matrix), vectors = shared.value, Vectors()
        for x in batches:
            best, score = x.column(3).to_pylist(), x.column(4).to_pylist()
            for i, text in enumerate(x.column(1).to_pylist()):
                grams, counts = trigrams(text or "")
                if not len(grams):
                    continue
                v = vectors.bundle(grams, counts)
                cosines = matrix @ v / max(np.sqrt(v @ v), 1e-300)
                k = int(cosines.argmax())
                if best[i] is None or cosines[k] > score[i]:
                    best[i], score[i] = names[k], float(cosines[k])
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "text", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id string, text string, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document of docs (doc_id, text, lang)."""
    spark = docs.sparkSession
    cuts, rows = Cuts(spark), fold(docs)
    with bounded(spark):
        counted = cuts.write(profiles(rows.where("not held_out")))
        learned = cuts.write(prototypes(counted))
        cuts.drop(counted)
        norms = cuts.write(learned.groupBy("lang").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).where("norm > 0"))
        out = rows.select("doc_id", "text", "held_out", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score"))
        last = None
        while block := (norms if last is None else norms.where(F.col("lang") > last)).orderBy("lang").limit(BLOCK).collect():  # a block of languages
            last, place = block[-1]["lang"], {r["lang"]: i for i, r in enumerate(block)}
            matrix = np.zeros((len(block), DIMS))
            for lang, i, x in learned.where(F.col("lang").between(block[0]["lang"], last)).select("lang", "place", "x").collect():
                if lang in place:
                    matrix[place[lang], i] = x / block[place[lang]]["norm"]
            out = _scored(out, [r["lang"] for r in block], matrix)
        told = out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("score"))
        return cuts.write(typed_id(told, docs))

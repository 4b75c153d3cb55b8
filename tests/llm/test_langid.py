import collections
import random
import zlib

import numpy as np
import pytest

from tidewater.llm import langid

SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def grams_of(text):
    """Trigrams of the words between blanks, by definition."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return collections.Counter(w[i : i + 3] for w in (f" {x} " for x in low.split(" ") if x) for i in range(len(w) - 2))


def vector(gram):
    out = np.ones(langid.DIMS)
    for place, c in enumerate(gram):
        raw = np.random.Philox(key=[langid.SEED, 0 if c == " " else ord(c)]).random_raw(langid.DIMS // 64)
        signs = np.unpackbits(raw.astype("<u8").view(np.uint8)).astype(float) * 2 - 1
        out *= np.roll(signs, place)
    return out


def brute(rows):
    made, held_out = {}, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    bundle = lambda counts: sum(n * made.setdefault(g, vector(g)) for g, n in counts.items())
    profiles = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if not held_out(i) and lang is not None and text:
            profiles[lang] += grams_of(text)
    learned = {k: v / np.sqrt(v @ v) for k, c in sorted(profiles.items()) if c and (v := bundle(c)) is not None}
    for i, text, _ in rows:
        counts = grams_of(text or "")
        if not counts or not learned:
            yield i, held_out(i), {"und"}, 0.0
            continue
        v = bundle(counts)
        cosines = {k: float(p @ v / np.sqrt(v @ v)) for k, p in learned.items()}
        best = max(cosines.values())
        yield i, held_out(i), {k for k, c in cosines.items() if c > best - 1e-5}, min(1.0, max(0.0, best))


def check(spark, rows):
    got = langid.identify(spark.createDataFrame([(*r, 5.0, "x") for r in rows], SCHEMA)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    for i, held_out, preds, score in brute(rows):
        r = by[i].pop() if i is not None else next(x for x in by[None] if x.lang_pred in preds and abs(x.score - score) < 1e-4)
        assert r.held_out == held_out and r.lang_pred in preds and abs(r.score - score) < 1e-4
    return got


def test_equals_its_definition(spark):
    r = random.Random(3)
    langs = {"en": "the ing and", "de": "der und ß ö", "ελ": "και της ΣΣ", None: "zz", "": "qq İ"}
    rows = [(i, r.choice(", 1-\n").join(r.choice((langs[k]).split(" ")).capitalize() + r.choice("aeiou") for _ in range(r.randrange(1, 30))), k) for i, k in enumerate(r.choices(list(langs), k=120))]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !?", "de"), (None, "the and", "en"), rows[5], rows[5], (1003, "x", "12"), (1004, "...", "no letters")]
    check(spark, rows)


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    r = random.Random(4)
    words = {f"l{k:02}": ["".join(r.choices("abcdefghij", k=6)) for _ in range(4)] for k in range(24)}
    rows = [(i, " ".join(r.choices(words[k], k=12)), k) for i, k in enumerate(list(words) * 5)]
    got = check(spark, rows)
    assert len({x.lang_pred for x in got}) > 20


def test_long_texts_run_on_over_slices():
    text = ("Äb cd-efg " * 150_000)[:-1]
    grams, counts = langid.trigrams(text)
    want = grams_of(text)
    mask = (1 << langid.BITS) - 1
    names = ["".join(chr(int(g) >> k * langid.BITS & mask) if int(g) >> k * langid.BITS & mask else " " for k in (2, 1, 0)) for g in grams]
    assert len(text) > langid.SLICE and dict(zip(names, counts.tolist(), strict=True)) == dict(want)


def test_many_trigrams_are_bundled_alike():
    v = langid.Vectors()
    grams = np.arange(70, 70 + langid.KEPT // 2, dtype=np.int64)
    counts = np.ones(len(grams), np.int64)
    parts = sum(v.bundle(grams[s : s + 100], counts[s : s + 100]) for s in range(0, len(grams), 100))
    assert np.abs(v.bundle(grams, counts) - parts).max() < 1e-3


def test_nothing_learned_and_empty_table(spark):
    assert [tuple(r) for r in langid.identify(spark.createDataFrame([(1, "the", None, 0.0, "")], SCHEMA)).collect()] == [(1, False, "und", 0.0)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    said = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in said) > 0.98 * len(said) > 200

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import brown
from tidewater.llm.tokens import hashed_words


def base(rows):
    seen, n = Counter(), 0
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    for h, t in zip(held, tokens, strict=True):
        if not h:
            seen.update(t)
            n += len(t)
    return [(h, len(t), sum(seen[w] > 0 for w in t), n, sum(math.log10((seen[w] + 1) / (n + len(seen) + 1)) for w in t)) for h, t in zip(held, tokens, strict=True)]


def test_base_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "null id"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "long " * 60_000 + "x" * 100_000), (10**6 + 2, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, c int, row int")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in brown.score(docs).collect()), key=key)
    want = sorted(((i, *b) for (i, _), b in zip(rows, base(rows), strict=True)), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1])  # better than the base on held-out texts
    assert brown.score(docs.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = brown.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0) and math.isfinite(r.score)


def test_gains_are_changes_of_the_likelihood():
    rng = np.random.default_rng(1)
    units, classes = 12, 4
    pair = rng.integers(0, 9, (units, units)).astype(float)
    group = rng.integers(0, classes, units)

    def likelihood(g):
        one = np.eye(classes)[g]
        n = one.T @ pair @ one
        return brown.phi(n).sum() - brown.phi(n.sum(0)).sum() - brown.phi(n.sum(1)).sum()

    one = np.eye(classes)[group]
    got = brown.gains(5, group, one.T @ pair @ one, pair @ one, pair.T @ one, pair[5, 5])
    want = []
    for k in range(classes):
        g = group.copy()
        g[5] = k
        want.append(likelihood(g))
    assert got - got[0] == pytest.approx(np.array(want) - want[0])


def hashes_of(words):
    return dict(zip(words, hashed_words(pa.array([" ".join(w.decode() for w in words)]))[0].tolist(), strict=True))


def fitted(spark, rows, s):
    docs = brown.fold(spark.createDataFrame(rows, "doc_id long, text string"))
    counts, m = brown.fit(docs, s, brown.Cuts(spark))
    return {r["h"]: (r["c"], r["class"]) for r in counts.collect()}, m


def corpus(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()]
    return rows + [(10**6, None), (10**6 + 1, "Unseen words\there"), (10**6 + 2, "the THE the")]


SMALL = brown.Settings(classes=7, own=2e-3, common=5e-4, rounds=30, tolerance=0.0)


def test_distributions_sum_to_one(spark):
    words, m = fitted(spark, corpus(spark), SMALL)
    k = SMALL.classes
    assert np.power(10, m.moves).sum(axis=1) == pytest.approx(np.ones(k + 1))
    mass = np.zeros(k)
    for c, kind in words.values():
        mass[kind] += c - m.discount
    mass[0] += m.ends - m.discount
    assert (mass + m.spare) / np.power(10, m.room) == pytest.approx(np.ones(k))


def test_every_word_has_a_class_and_likelihood_rises(spark):
    rows = corpus(spark)
    words, m = fitted(spark, rows, SMALL)
    train = [(t or "").encode().lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(w for t in train for w in t)
    name = hashes_of(list(seen))
    assert {h: c for h, (c, _) in words.items()} == {name[w]: c for w, c in seen.items()}
    assert all(1 <= kind < SMALL.classes for _, kind in words.values())
    exchanged, settled = m.risen
    assert len(exchanged) > 2 and all(b > a for a, b in zip(exchanged, exchanged[1:], strict=False))
    assert len(settled) > 2 and all(b >= a - 1e-6 * abs(a) for a, b in zip(settled, settled[1:], strict=False))
    # the last likelihood is that of the classes returned
    n, kinds = m.tokens, {w: words[name[w]][1] for w in seen}
    frequent = {w for w, c in seen.items() if c >= max(2.0, SMALL.own * n)}
    pairs = Counter()
    for t in train:
        path = [0] + [kinds[w] if w in frequent else SMALL.classes for w in t]
        pairs.update(zip(path, [kinds[w] for w in t] + [0], strict=True))
    margin = Counter()
    for (_, b), c in pairs.items():
        margin[b] += c
    assert settled[-1] == pytest.approx(sum(c * math.log(c) for c in pairs.values()) - sum(c * math.log(c) for c in margin.values()))


def test_score_matches_brute_force(spark):
    rows = corpus(spark)
    words, m = fitted(spark, rows, SMALL)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {i: (t or "").encode().lower().split() for i, t in rows}
    seen = Counter(w for i, t in texts.items() if not held(i) for w in t)
    name = hashes_of(list(seen))
    kinds, k = {w: words[name[w]][1] for w in seen}, SMALL.classes
    ends = sum(not held(i) for i in texts)
    n = sum(seen.values()) + ends
    frequent = {w for w, c in seen.items() if c >= max(2.0, SMALL.own * n)}
    history = lambda w: kinds[w] if w in frequent else k
    pairs, mass, number = Counter(), Counter({0: ends}), Counter({0: 1})
    for w, c in seen.items():
        mass[kinds[w]] += c
        number[kinds[w]] += 1
    for i, t in texts.items():
        if not held(i):
            pairs.update(zip([0] + [history(w) for w in t], [kinds[w] for w in t] + [0], strict=True))
    out = Counter()
    for (a, _), c in pairs.items():
        out[a] += c
    once, twice = sum(c == 1 for c in seen.values()), sum(c == 2 for c in seen.values())
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    total = sum(mass[c] + 1 for c in range(k))

    def move(a, b):
        return (pairs[a, b] + k * (mass[b] + 1) / total) / (out[a] + k)

    def probability(a, w):
        if w is None:
            return move(a, 0) * (ends - d) / (mass[0] + 0.5)
        if w in seen:
            return move(a, kinds[w]) * (seen[w] - d) / (mass[kinds[w]] + 0.5)
        return sum(move(a, b) * (d * number[b] * (mass[b] > 0) + 0.5) / (mass[b] + 0.5) for b in range(k))

    want = {i: sum(math.log10(probability(a, w)) for a, w in zip([0] + [history(w) if w in seen else k for w in t], [*t, None], strict=True)) for i, t in texts.items()}
    got = {r.doc_id: r.score for r in brown.score(spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    assert got.keys() == want.keys()
    assert [got[i] for i in want] == pytest.approx([want[i] for i in want], rel=1e-9)

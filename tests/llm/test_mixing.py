import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import mixing, topics
from tidewater.llm.common import Cuts
from tidewater.llm.mixing import OTHER, Targets
from tidewater.llm.tokens import hashed_words


def plain_rake(counts, wanted, budget, rounds=400):
    """Expected tokens by cell: factors of each marginal in turn by bisection. wanted: a dict of shares for each marginal."""
    total = budget * sum(counts.values())
    factor = [dict.fromkeys(w, 1.0) for w in wanted]
    value = lambda c: min(counts[c], counts[c] * budget * math.prod(f[k] for f, k in zip(factor, c, strict=True)))
    for _ in range(rounds):
        for i, w in enumerate(wanted):
            for k, share in w.items():
                cells = [c for c in counts if c[i] == k]
                low, high = -60.0, 60.0
                for _ in range(80):
                    factor[i][k] = math.exp((low + high) / 2)
                    if sum(map(value, cells)) < share * total:
                        low = (low + high) / 2
                    else:
                        high = (low + high) / 2
    return {c: value(c) for c in counts}


def tempered(counts, budget, power=0.7):
    """Shares by level of each marginal: cells raised to a power, scaled to the budget by bisection, none above its count."""
    low, high, total = 0.0, max(counts.values()) + 1.0, budget * sum(counts.values())
    for _ in range(200):
        a = (low + high) / 2
        low, high = (a, high) if sum(min(n, a * n**power) for n in counts.values()) < total else (low, a)
    out = [Counter(), Counter(), Counter()]
    for c, n in counts.items():
        for i, k in enumerate(c):
            out[i][k] += min(n, a * n**power) / total
    return out


def plain_topic(text, centroids):
    h, _ = hashed_words(pa.array([text]))
    seen = Counter(x % 2**64 % topics.WIDTH for x in h.tolist())
    if not seen:
        return None
    size = math.sqrt(sum(seen.values()))
    v = [float(np.float16(math.sqrt(seen[k]) / size)) for k in range(topics.WIDTH)]
    near = [sum(a * b for a, b in zip(v, c, strict=True)) for c in centroids.tolist()]
    return f"topic{near.index(max(near))}"


def plain_mix(rows, centroids, targets):
    """Probabilities of rows (source, lang, text), tempered targets, all values named."""
    cell = [(s or OTHER, g or OTHER, plain_topic(t, centroids) or OTHER) for s, g, t in rows]
    size = [len((t or "").encode().split()) for *_, t in rows]
    counts = Counter()
    for c, n in zip(cell, size, strict=True):
        if n:
            counts[c] += n
    expected = plain_rake(counts, tempered(counts, targets.budget, targets.power), targets.budget)
    return [expected[c] / counts[c] if n else 0.0 for c, n in zip(cell, size, strict=True)]


def test_rake_meets_marginals():
    targets = Targets({"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.4, OTHER: 0.1}, {"t": 1.0}, budget=0.01)
    counts = {("a", "x", "t"): 1000, ("a", "y", "t"): 100, ("b", "x", "t"): 50_000, ("b", "y", "t"): 7000}
    r = mixing.rake(counts, targets)
    w = r.expected
    assert r.converged and sum(w.values()) == pytest.approx(581)
    assert sum(v for k, v in w.items() if k[0] == "a") == pytest.approx(0.7 * 581)
    assert sum(v for k, v in w.items() if k[1] == "x") == pytest.approx(5 / 9 * 581)  # a level without tokens is dropped
    odds = lambda c: c[("a", "x", "t")] * c[("b", "y", "t")] / c[("a", "y", "t")] / c[("b", "x", "t")]
    free = {k: v for k, v in w.items() if v < counts[k]}
    assert len(free) < 4 or odds(w) == pytest.approx(odds(counts))  # raking keeps odds ratios
    assert all(t == pytest.approx(e) for _, _, t, e in r.shares)


def test_rake_under_the_bound_is_brute_force():
    rng = np.random.default_rng(3)
    for budget, power in ((0.3, 0.7), (0.8, 0.0)):
        counts = {(f"s{i}", f"g{j}", f"t{k}"): int(rng.integers(1, 5000)) for i in range(4) for j in range(3) for k in range(3) if rng.random() < 0.8}
        r = mixing.rake(counts, Targets(budget=budget, power=power))
        want = plain_rake(counts, tempered(counts, budget, power), budget)
        assert r.converged and [r.expected[c] for c in counts] == pytest.approx([want[c] for c in counts], rel=1e-5)
    # without the bound the first cell would give 225 of its 100 tokens
    counts = {("a", "x", "t"): 100, ("a", "y", "t"): 1000, ("b", "x", "t"): 1000, ("b", "y", "t"): 1000}
    r = mixing.rake(counts, Targets({"a": 0.6, "b": 0.4}, {"x": 0.45, "y": 0.55}, None, budget=0.5))
    assert r.converged and [r.expected[c] for c in counts] == pytest.approx([100, 830, 597.5, 22.5], rel=1e-6)


def test_shortfall_is_reported(spark):
    counts = {("a", "x", "t"): 10, ("b", "x", "t"): 500}
    r = mixing.rake(counts, Targets({"a": 0.7, "b": 0.3}, {"x": 1.0}, {"t": 1.0}, budget=0.5), rounds=50)
    assert r.expected[("a", "x", "t")] == 10 and not r.converged
    rows = {(x.marginal, x.level): x for x in mixing.shares(r, spark.range(1)).collect()}
    assert rows["source", "a"].shortfall == pytest.approx(0.7 - rows["source", "a"].expected) and rows["source", "a"].shortfall > 0.5
    assert mixing.rake({("a", "x", "t"): 7}, Targets({"z": 1.0}, {}, None, budget=1.0)).expected == {("a", "x", "t"): 7.0}


def test_topics_are_fitted_on_all_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cuts = Cuts(spark)
    rows = cuts.write(topics.hashed(docs, "doc_id"))
    centroids, risen = topics.fit(rows, 5, cuts)
    assert centroids.shape == (5, topics.WIDTH) and all(b >= a - 1e-6 for a, b in zip(risen, risen[1:], strict=False))
    x = np.stack([np.frombuffer(r.v, np.float16).astype(float) for r in rows.collect() if r.n])
    at = topics.nearest(x, centroids)
    means = topics.unit(np.stack([x[at == k].sum(axis=0) for k in range(5)]))
    assert ((means * centroids).sum(axis=1) > 0.99).all()


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = Targets()
    rows = mixing.mixed(docs, targets).collect()
    assert len(rows) == docs.count()
    centroids = mixing.fit(docs, targets, Cuts(spark)).centroids
    want = plain_mix([(r.source, r.lang, r.text) for r in rows], centroids, targets)
    assert [r.probability for r in rows] == pytest.approx(want, rel=1e-4)
    assert [r.kept for r in rows] == [r._u < r.probability for r in rows]
    total = sum(r._n for r in rows)
    assert sum(r._n * r.probability for r in rows) == pytest.approx(0.6 * total, rel=1e-3)
    assert 0.55 < sum(r._n for r in rows if r.kept) / total < 0.65
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, kept int, probability string, _u int"
    rows = [(None, None, None, None, 1, "p", 2), (1, "", "src0", "en", 1, "p", 2), (2, "w " * 90_000, "elsewhere", "xx", 1, "p", 2), (2, "w " * 90_000, "elsewhere", "xx", 1, "p", 2)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.sample(docs, Targets(budget=1.0))
    assert out.columns == docs.columns and [(r.doc_id, r.kept, r.probability, r._u) for r in out.collect()] == [(2, 1, "p", 2)] * 2
    assert mixing.sample(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(2)).count() == 0
    own = docs.withColumn("topic", mixing.F.lit("given"))
    assert {r._topic for r in mixing.mixed(own.drop("kept", "probability", "_u"), Targets(budget=1.0)).collect()} == {"given"}


def many(spark, sources, n):
    """n documents of many sources, of which one has a third."""
    return spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, CAST(5 + id % 17 AS INT)), k -> concat('w', hash(id, k) % 50))) AS text", f"CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % {sources - 1}) END AS source", "CASE id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END AS lang", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS topic")


def test_every_source_has_a_share_of_its_own(spark):
    docs = many(spark, 5000, 40_000)
    raked = mixing.fit(docs, Targets(), Cuts(spark))
    shares = {k: (t, e) for d, k, t, e in raked.shares if d == "source"}
    assert len(shares) == 5000 and OTHER not in shares and raked.converged
    assert all(abs(t - e) < 1e-6 for t, e in shares.values()) and shares["hot"][0] < 0.3


@pytest.mark.parametrize("targets", [Targets(), Targets({"hot": 0.4, "s1": 0.6}, {"x": 0.6, OTHER: 0.4}, None, budget=0.01)])
def test_tables_give_what_arrays_give(spark, monkeypatch, targets):
    docs = many(spark, 30, 3000)
    plain = mixing.fit(docs, targets, Cuts(spark))
    monkeypatch.setattr(mixing, "CELLS", 5)
    raked = mixing.fit(docs, targets, Cuts(spark))
    got = {tuple(r[c] for c in mixing.CELL): r.expected for r in raked.cells.collect()}
    assert plain.converged and raked.converged and set(got) == set(plain.expected)
    most = sum(plain.expected.values())
    assert all(abs(x - plain.expected[c]) < 1e-4 * most for c, x in got.items())
    wanted = {(d, k): t for d, k, t, _ in plain.shares}
    rows = mixing.shares(raked, docs).collect()
    assert {(r.marginal, r.level) for r in rows} == set(wanted) and all(abs(r.target - wanted[r.marginal, r.level]) < 1e-9 and abs(r.shortfall) < 1e-4 for r in rows)
    out = mixing.mixed(docs, targets)
    tokens = out.agg({"weight": "max"}).first()[0]
    assert 0 < tokens <= 1 and 0 < out.where("kept").count() < 3000

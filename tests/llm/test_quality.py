from collections import Counter

import numpy as np
import pytest

from tidewater.llm import quality


def plain(text):
    words = [w.decode() for w in (text or "").encode().split()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    dup = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_counts(spark):
    texts = [None, "", " \x0b\x0c", "a b c a b c", "x" * 100_000, "ä\n\nä\n b \nä", "1 2 3 4 1 2 3 1 2 3\r\n", "#| <>&", "a " * 3000, "    no\u0085break", " ".join(f"w{i % 70}" for i in range(140))]
    docs = spark.createDataFrame([(i, t, "en", None, 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    out = quality.judge(docs.drop("n_words"), ["doc_id"]).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id]), r.doc_id
    assert len(out) == len(texts) and not any(r.kept for r in out if r.base_failed)
    assert quality.judge(docs.limit(0), ["doc_id"]).count() == 0
    left = quality.drop_rejected(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in out if r.kept}


def squared(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def steps(x, floors, centre, cov, lower=quality.LOWER):
    """Concentration steps until the determinant no longer falls: (logdet, centre, covariance)."""
    best, h = (np.inf, centre, cov), int(np.ceil(quality.SUPPORT * len(x)))
    while True:
        rank = np.round(1000 * np.log1p(squared(x, *best[1:])))
        edge = np.sort(rank)[h - 1]
        w = np.where(rank < edge, 1.0, np.where(rank == edge, (h - (rank < edge).sum()) / (rank == edge).sum(), 0.0))
        centre = w @ x / h
        cov = (x * w[:, None]).T @ x / h - np.outer(centre, centre) + np.diag(np.square(floors))
        new = (np.linalg.slogdet(cov)[1], centre, cov)
        if new[0] >= best[0] - lower:
            return new
        best = new


def concentration(x, floors):
    """The estimate of least determinant in numpy: distances."""
    centre = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), floors)
    z = (x - centre) / spread
    found = []
    for y in (None, np.tanh(z), z / np.maximum(np.sqrt((z**2).sum(axis=1)), 1e-9)[:, None]):
        like = np.eye(len(spread))
        if y is not None:
            y = np.round(1000 * y)
            size = np.sqrt((y**2).sum(axis=0))
            like = y.T @ y / np.maximum(np.outer(size, size), 1.0)
        found.append(steps(x, floors, centre, np.outer(spread, spread) * (like + 0.01 * np.eye(len(spread)))))
    d2 = squared(x, *min(found, key=lambda e: e[0])[1:])
    return d2 / max(1.0, np.expm1(np.quantile(np.round(1000 * np.log1p(d2)), 0.5) / 1000) / quality.CHI2_MEDIAN)


def test_least_determinant_of_small_groups(spark):
    """No search from random subsets, as many as you like, finds a determinant much below the operator's."""
    from tidewater.llm.common import Cuts

    rng, floors, data = np.random.default_rng(4), np.array(quality.FLOORS, float), []
    for g in range(4):
        x = rng.normal(0, 1, (60, 5)) @ rng.normal(0, 400, (5, 5)) + 5000
        x[: 4 * g] = rng.normal(9000, 200, (4 * g, 5))  # a cluster of outliers
        data += [(0, "en", f"s{g}", *map(int, row)) for row in x.round()]
    rows = spark.createDataFrame(data, "level int, judge_lang string, judge_source string, " + ", ".join(f"{f} long" for f in quality.FEATURES))
    got = {r.judge_source: r for r in quality.fit(rows, Cuts(spark)).collect()}
    for g in range(4):
        x = np.array([d[3:] for d in data if d[2] == f"s{g}"], float)
        tried = []
        for _ in range(300):
            some = x[rng.choice(len(x), 6, replace=False)]
            tried.append(steps(x, floors, some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(np.square(floors)), 1e-9)[0])
        r = got[f"s{g}"]
        assert r.logdet <= min(tried) + 0.1
        factor = np.zeros((5, 5))
        for j in range(5):
            for k in range(j + 1):
                factor[j, k] = r[f"l{j}{k}"]
        d2 = squared(x, np.array([r[f"m{j}"] for j in range(5)]), factor @ factor.T) / r.scale
        assert (d2[: 4 * g] > quality.CUTOFF).all() and (d2[4 * g :] < quality.CUTOFF).mean() > 0.9


def test_estimate_matches_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").withColumn("source", quality.F.lit("one"))
    from tidewater.llm.common import Cuts

    cuts = Cuts(spark)
    rows = cuts.write(quality.with_features(quality.statistics(docs)).select("doc_id", "base_failed", *quality.GROUP, *quality.FEATURES))
    pdf = rows.where("not base_failed").toPandas()
    want = concentration(pdf[list(quality.FEATURES)].to_numpy(float), np.array(quality.FLOORS, float))
    got = quality.judge(docs, ["doc_id"]).where("not base_failed").toPandas().set_index("doc_id")["distance"]
    assert got.loc[pdf["doc_id"]].to_numpy() == pytest.approx(want, rel=1e-6)

import random

import pytest

import corpus_pipeline


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows, similarity=0.8):
    """Row numbers that stay, by brute force."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] == least[find(i)]]


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.random()}"
    return " ".join(out)


def corpus():
    rng = random.Random(5)
    base = [[f"{k}v{i}" for i in range(200)] for k in range(12)]
    texts = [" ".join(b) for b in base] + [edited(b, n, rng) for b in base for n in (1, 2, 3, 4, 5, 8)]
    texts += [edited(base[0], 2, rng) for _ in range(120)]  # a dense group, of which many pairs don't link
    texts += [None, "", " \t", "a", "A", "a b", " ".join(base[1]).upper(), "dup " * 20, "dup " * 30]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    # ids with two texts: one has a copy under a smaller id, the other none
    return rows + [(1000, texts[7]), (1000, "a text of its own that nothing else in here says"), (None, texts[3]), (None, "x")]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_near_dedup_stage_is_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, node string")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    want = kept(rows)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)
    assert (1000, rows[-3][1]) in want and (1000, rows[-4][1]) not in want
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_dedup_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=key)
    assert got == sorted(kept(rows), key=key)

import numpy as np
import xxhash

from tidewater.llm.common import Cuts, components
from tidewater.llm.simhash import drop_near_copies, fingerprint, link_edges, simhash_groups, trie_join


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_trie_join_is_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    near = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(5), base ^ np.uint64(1 << 60)])
    a = np.unique(near)
    i, j = trie_join(a, a, 0, 2)
    want = {(x, y) for x in range(len(a)) for y in range(len(a)) if int(a[x] ^ a[y]).bit_count() <= 2}
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_groups_match_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \t", "a", "A b", "a b", base, base, base + " x", base.upper(), "é " * 5000, "dup dup dup dup", "dup dup dup"]
    texts += [" ".join(f"{k}v{i}" for i in range(200)) + tail for k in range(20) for tail in ("", " end")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp int, rep int")
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert all(fingerprint(t) % 2**64 == want[i] for i, t in enumerate(texts))
    root = groups(want)
    for leaf in (1 << 16, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(docs, leaf=leaf).collect()}
        assert got == {i: (f"{want[i]:016x}", root[i]) for i in want}
    kept = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert kept == set(root.values())


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (7, None)], schema)
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash_groups(rows).collect()), key=str)
    assert got == [(False, 4, 4), (False, 4, 4), (False, 7, 7), (True, None, 4)]


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: fingerprint(t) % 2**64 for i, t in rows.items()}
    assert {r.doc_id: r.component_id for r in simhash_groups(docs).collect()} == groups(prints)


def test_hot_nodes_are_descended(spark):
    """Fingerprints that share a long prefix, with leaves of three: pairs of nodes of different depths."""
    rng = np.random.default_rng(2)
    low = rng.integers(0, 1 << 12, 150, dtype=np.uint64) << np.uint64(46)
    prints = np.unique(np.concatenate([low, low ^ np.uint64(3 << 40), low ^ np.uint64(1 << 63), rng.integers(0, 2**63, 60, dtype=np.uint64)]))
    unique = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = groups(dict(enumerate(prints.tolist())))
    for limits in ({"leaf": 3, "top": 4, "step": 4}, {}):
        cuts = Cuts(spark)
        found = components(link_edges(unique, cuts, 2, **limits), cuts).collect()
        at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
        least = {}
        for r in found:
            least[r.component] = min(least.get(r.component, len(at)), at[r.node])
        got = dict.fromkeys(range(len(at)), None) | {at[r.node]: least[r.component] for r in found}
        assert {i: i if c is None else c for i, c in got.items()} == want


def test_null_ids_link_and_bridge(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:k] + ["x"] + base[k:]) for k in range(0, 400, 3)]
    prints = [plain(t) for t in texts]
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2
    a, b, c = next((a, b, c) for b in range(len(texts)) for a in range(len(texts)) for c in range(a) if near(a, b) and near(b, c) and not near(a, c) and prints[a] != prints[b] != prints[c])
    docs = spark.createDataFrame([(5, texts[a]), (None, texts[b]), (3, texts[c]), (None, "alone without an id")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (None, 3), (3, 3), (None, None)], key=str)

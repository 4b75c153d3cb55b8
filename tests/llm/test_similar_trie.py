import numpy as np

from tidewater.llm import similar
from tidewater.llm.common import Cuts


def test_fingerprint_is_the_majority_of_bits():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, similar.BLOCK + 5):
        grams = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        want = sum(1 << k for k in range(64) if 2 * sum(int(g) >> k & 1 for g in grams) > n)
        assert similar.fingerprint(grams) % (1 << 64) == want


def test_trie_proposes_what_links_within_the_budget(spark):
    words = [" ".join(f"w{k}v{i}" for i in range(3000)) for k in range(3)]
    texts = words + [f"{words[0]} more", f"{words[1]} other", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cuts = Cuts(spark)
    nodes = cuts.write(similar.nodes_of(rows)).select("doc_id", "node", "fp")
    held = {r.node: r for r in nodes.collect()}
    pairs = similar.trie_pairs(nodes.select("node", "fp"), cuts).collect()
    got = {tuple(sorted((held[r.a].doc_id, held[r.b].doc_id))) for r in pairs}
    assert got == {(0, 3), (1, 4)}


def test_the_stage_goes_through_the_trie(spark, monkeypatch):
    asked = []
    inner = similar.link_edges
    monkeypatch.setattr(similar, "link_edges", lambda *a, **k: asked.append(1) or inner(*a, **k))
    text = " ".join(f"v{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other")], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == [1, 3] and asked

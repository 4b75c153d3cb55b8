import numpy as np

from tidewater.llm import hnsw


def vectors():
    x = np.random.default_rng(7).normal(size=(600, 16)).astype(np.float32)
    x[301] = x[300] + 0.001
    return x


def blind(beam):
    """A search that finds nothing but the query itself."""

    def run(self, k, q, at, width, limit):
        ids, sim = beam(self, k, q, at, width, limit)
        return ids, np.where(sim > 0.999999, sim, -np.inf).astype(np.float32)

    return run


def pairs(found):
    return {(int(a), int(b)) for i, j in found for a, b in zip(i, j, strict=True) if a != b}


def test_own_matches_are_no_evidence(monkeypatch):
    x = vectors()
    graph = hnsw.Graph(x)
    monkeypatch.setattr(hnsw, "Graph", lambda v: graph)
    monkeypatch.setattr(type(graph), "beam", blind(type(graph).beam))
    shard = hnsw.Shard(x)
    assert shard.width is None and shard.recall < hnsw.RECALL
    assert pairs(shard.links(x)) >= {(300, 301), (301, 300)}


def test_queries_of_other_shards_are_audited(monkeypatch):
    x = vectors()
    shard = hnsw.Shard(x)
    assert shard.width is not None
    monkeypatch.setattr(hnsw.Graph, "beam", blind(hnsw.Graph.beam))
    q = x[:500] + np.float32(0.002)
    assert {(i, i) for i in range(500)} <= {(int(a), int(b)) for i, j in shard.links(q, foreign=True) for a, b in zip(i, j, strict=True)}

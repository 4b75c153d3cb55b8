import numpy as np

from tidewater.llm import hnsw


def plain(ids, x, labels, least=0.98):
    ok = [v is not None and lab is not None and i is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, lab in zip(ids, x, labels, strict=True)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(x, ok, strict=True)]
    links, root = [0] * len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least_id = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least_id[find(i)] = min(least_id.get(find(i), ids[i]), ids[i])
    return {(ids[i], links[i], least_id.get(find(i))) for i in range(len(ids))}


def data():
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16).astype(np.float32) for _ in range(150)]
    x += [x[0] + rng.normal(size=16).astype(np.float32) * 0.01 for _ in range(90)] + [x[1]] * 20
    x += [x[2] + rng.normal(size=16).astype(np.float32) * 0.09 * k for k in range(1, 5)] + [x[3] * 2]
    return x


def test_matches_brute_force(spark):
    x = [v.tolist() for v in data()]
    labels = [i % 2 if i > 5 else 0 for i in range(len(x))]
    x += [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, x[0], x[0], x[0][:8], []]
    labels += [0, 0, 0, 0, 0, None, 0, 0, 0]
    ids = [3 * i + 1 for i in range(len(x) - 3)] + [None, 5000, 5001]
    df = spark.createDataFrame(list(zip(ids, x, labels, ["e"] * len(x), strict=True)), "vec_id long, embedding array<float>, label int, rep string")
    for limits in ({}, {"shard": 40}, {"shard": 40, "queries": 30}):
        got = {(r.vec_id, r.n_links, r.component_id) for r in hnsw.near_copies(df, **limits).collect()}
        assert got == plain(ids, x, labels)
    assert hnsw.near_copies(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x = np.concatenate([x, x[:600] + rng.normal(size=(600, 64)).astype(np.float32) * 0.08, np.repeat(x[:1], 400, 0) + rng.normal(size=(400, 64)).astype(np.float32) * 0.02])
    shard = hnsw.Shard(x)
    assert shard.width is not None and shard.recall >= hnsw.RECALL
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    truth = set(zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True))
    found = {p for i, j in shard.links(x) for p in zip(i, j, strict=True)}
    assert found <= truth and len(found) >= 0.97 * len(truth)
    # planted pairs by themselves: neither matches with oneself nor the dense cluster count
    planted = {(i, 3000 + i) for i in range(600) if unit[i] @ unit[3000 + i] >= 0.98}
    assert len(planted) > 100 and len(found & planted) >= 0.97 * len(planted)
    near = {(j, i) for i, j in found} | found
    assert planted <= near

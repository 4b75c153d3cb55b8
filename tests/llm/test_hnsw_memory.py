import resource
import subprocess
import sys

import numpy as np

from tidewater.llm import hnsw

DENSE = """
import resource, sys
import numpy as np, pandas as pd
from tidewater.llm import hnsw
n = hnsw.SHARD
rng = np.random.default_rng(3)
x = (rng.normal(size=32) + rng.normal(size=(n, 32)) * 0.02).astype(np.float32)
rows = pd.DataFrame({"label": 1, "dim": 32, "target": 0, "slice": 0, "rep": np.arange(n) * 10, "times": 1 + np.arange(n) % 3, "embedding": list(x), "query": False})
queries = rows[:2000].assign(query=True, rep=-1 - np.arange(2000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
out = pd.concat(hnsw.search(iter([rows, queries[:1000], queries[1000:]]), 0.98))
own = out[~out["edge"]]
total = int(rows["times"].sum())
links = own.set_index("rep")["links"]
assert (links.loc[rows["rep"]].to_numpy() == total - rows["times"].to_numpy()).all()
assert (links.loc[queries["rep"]].to_numpy() == total).all()
assert out["edge"].sum() <= n + 2000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_full_shard_that_all_links_takes_bounded_memory():
    """16,384 vectors that all link with each other, and 2,000 queries that link with all of them."""
    run = subprocess.run([sys.executable, "-c", DENSE], capture_output=True, text=True, cwd=sys.path[0], env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path), "OMP_NUM_THREADS": "2"})
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout) < 1500


def test_own_links_count_from_either_end(monkeypatch):
    """Links that only one of two rows finds count for both."""
    x = np.random.default_rng(1).normal(size=(1300, 8)).astype(np.float32)
    x[700:] = x[:600] + np.float32(0.001)
    shard = hnsw.Shard(x)
    plain = shard.links
    monkeypatch.setattr(shard, "links", lambda v: ((i[i <= j], j[i <= j]) for i, j in plain(v)))
    times = np.arange(1300)
    links, label = shard.own(x, times)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert (links == near @ times).mean() > 0.99 and (links[:600] >= times[700:]).all()
    assert (label[700:] <= np.arange(600)).all() and resource.RUSAGE_SELF == 0

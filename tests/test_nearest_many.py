import numpy as np
import pytest

from tidewater.operators.search import MOST, blocks_of, nearest_many


def brute(queries, rows, k, others):
    out = set()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    for i, v in [(i, v) for i, v in queries if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]:
        v = np.array(v, float)
        d = sorted((round(1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w), 9), j) for j, w in good if not (others and i == j))
        out |= {(i, j, rank) for rank, (_, j) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize(("k", "block", "others"), [(3, 7, False), (3, 7, True), (50, 1000, True)])
def test_equals_all_distances(spark, k, block, others):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 4)).astype(np.float32).astype(float))]
    rows += [(100 + i, rows[0][1]) for i in range(12)]  # ties over all blocks
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [float("nan")] * 4), (204, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "chunk_id long, embedding array<double>, query string")
    queries = df.where("chunk_id is null or chunk_id % 2 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.chunk_id, r.rank) for r in nearest_many(queries, df, k, block=block, others=others).collect()}
    assert got == brute([r for r in rows if r[0] is None or r[0] % 2 == 0], rows, k, others)
    assert nearest_many(queries.limit(0), df, k).count() == 0 and nearest_many(queries, df.limit(0), k).count() == 0


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "chunk_id long, embedding array<double>")
    with pytest.raises(Exception, match="one length"):
        nearest_many(df.withColumnRenamed("chunk_id", "query_id"), df, 1).collect()


def test_what_is_dealt_grows_no_faster_than_the_tables():
    """A vector meets as many blocks of the other side in a table five or sixty times as large; a block stays bounded."""
    assert blocks_of(9_000, 64) == blocks_of(45_000, 64) == blocks_of(300_000, 64)
    assert 600_000 // blocks_of(600_000, 64) <= MOST // 64 and 50_000 // blocks_of(50_000, 1536) <= MOST // 1536
    assert blocks_of(0, 1) == blocks_of(500, 64) == 1

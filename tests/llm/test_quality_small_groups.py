import numpy as np
import pytest
from test_pipeline import features
from test_quality import concentration, plain

from tidewater.llm import quality


def distances(rows):
    """Distances of the rows (by id) that pass the base rules, and the levels of groups that were needed."""
    passed = sorted(i for i, r in rows.items() if not plain(r.text)[5])
    x = {i: features(rows[i].text) for i in passed}
    group = lambda i, k: ((rows[i].lang, rows[i].source), (rows[i].lang,), ())[k]
    want, levels = {}, set()
    for k in range(3):
        judged = {}
        for g in {group(i, k) for i in passed}:
            ids = [i for i in passed if group(i, k) == g]
            if (len(ids) >= quality.MIN_ROWS or k == 2) and any(i not in want for i in ids):
                d = dict(zip(ids, concentration(np.array([x[i] for i in ids], float), np.array(quality.FLOORS, float)), strict=True))
                judged |= {i: d[i] for i in ids if i not in want}
                levels.add(k)
        want |= judged
    return want, levels


def test_small_groups_are_judged_by_language_then_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    spec = quality.F.when(quality.F.col("lang") == "en", quality.F.when(quality.F.col("doc_id") % 9 == 0, "tail").otherwise("hot")).otherwise(quality.F.concat(quality.F.lit("s"), quality.F.col("doc_id") % 40))
    lang = quality.F.when(quality.F.col("lang") == "en", "en").when(quality.F.col("doc_id") % 8 == 1, None).otherwise("other")
    docs = docs.where("doc_id < 600").withColumn("source", spec).withColumn("lang", lang).select("doc_id", "text", "lang", "source")
    rows = {r.doc_id: r for r in docs.collect()}
    want, levels = distances(rows)
    passed = sorted(want)
    assert levels == {0, 1, 2}
    got = {r.doc_id: r for r in quality.judge(docs, ["doc_id"]).collect()}
    assert set(got) == set(rows)
    assert [got[i].distance for i in passed] == pytest.approx([want[i] for i in passed], rel=1e-6)
    assert all(got[i].kept == (want[i] <= quality.CUTOFF) for i in passed)

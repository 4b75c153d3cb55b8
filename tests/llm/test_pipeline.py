import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bpe import plain_bpe
from test_lines import plain as plain_lines
from test_mixing import plain_mix
from test_quality import plain as plain_counts
from test_similar import grams

import corpus_pipeline
from tidewater.llm import mixing, quality
from tidewater.llm.common import Cuts


def features(text):
    words, chars, symbols, dup, repeated, _ = plain_counts(text)
    lines = sum(bool(x.encode().split()) for x in text.split("\n"))
    values = [np.log(words), np.log(chars / words), np.log1p(100 * symbols / chars), np.log1p(10 * dup / max(lines, 1)), np.log1p(10 * repeated / words)]
    return [np.floor(1000 * v + 0.5) for v in values]


def similar_roots(texts):
    """The least id of each group of texts (by id) linked by a five-word Jaccard of 0.8 or more."""
    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in sorted(sets)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in root:
        for j in root:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_run_matches_brute_force(spark, tmp_path):
    from test_quality_small_groups import distances

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.when(F.col("lang") == "en", "src0").otherwise(F.col("source")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = {r.doc_id: r for r in docs.collect()}
    ids = sorted(i for i, d in distances(rows)[0].items() if d <= quality.CUTOFF)
    text = dict(zip(ids, plain_lines([(i, rows[i].text, rows[i].source) for i in ids], 10), strict=True))
    ids = [i for i, r in similar_roots(text).items() if i == r]
    rest = spark.createDataFrame([(i, text[i], rows[i].lang, rows[i].source) for i in ids], docs.select("doc_id", "text", "lang", "source").schema)
    raked = mixing.fit(rest, mixing.Targets(), Cuts(spark))
    held = mixing.labelled(rest, raked, mixing.Targets().seed).collect()
    p = plain_mix([(r.source, r.lang, r.text) for r in held], raked.centroids, mixing.Targets())
    assert all(abs(r._u - x) > 1e-5 for r, x in zip(held, p, strict=True))  # no document hangs on the last digits
    want = {}
    for r, x in zip(held, p, strict=True):
        if r._u < x:
            tokens = plain_bpe(r.text)
            want[r.doc_id] = (len(tokens), hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert got == want and len(got) > 20


EDGES = "doc_id long, text string, lang string, source string, n_chars long, distance string, kept string, node string"


def edge_rows():
    long = " ".join(f"l{i}" for i in range(30_000))
    clean = " ".join(f"c{i}" for i in range(90))
    return [(None, None, None, None, None, None, None, None), (1, None, "en", None, 0, "a", "b", "c"), (2, "", None, "src1", 0, "a", "b", "c"), (3, long, "en", "src1", 5, "a", "b", "c")] + [
        (4, clean, "en", "src1", 5, "a", "b", "c")
    ] * 2 + [(None, clean, "en", "src1", 5, "a", "b", "c"), (4, clean + " but another text", None, None, 5, "a", "b", "c")]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(edge_rows(), EDGES)
    got = run(spark, docs, "").collect()
    assert run(spark, docs.limit(0), "").count() == 0
    if stage == "encode_tokens":
        assert len(got) == docs.count()
        return
    key = lambda r: str(tuple(r))
    rows = sorted(edge_rows(), key=str)
    left = sorted(map(tuple, got), key=key)
    assert all(r in rows for r in left)
    texts = {(r[0], r[1]) for r in left}
    if stage == "quality_rules":
        assert all(t and len(t.split()) >= 50 for _, t in texts) and (4, rows[0][1]) not in texts
    elif stage == "line_dedup":
        assert left == rows
    elif stage == "near_dedup":  # what has no id stays, and so do repeated rows of the id that leads its group
        assert [r for r in left if r[0] is None] == [r for r in rows if r[0] is None] and {r[0] for r in left} == {None, 1, 3, 4}


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", "src1", 0, "kept") for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long, distance string")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, "")
        assert sorted(out.columns) == sorted(docs.columns) and out.count() == 20


CLASHES = ["_id", "_mark", "_own", "_removed", "_gone", "_u", "_n", "_made", "_judged", "_print", "node", "mark", "rep", "distance", "kept", "weight", "probability", "component_id", "removed", "_own0", "a.b", "level"]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:4]] + ["near_copies"])
def test_columns_named_like_an_operators_keep_their_values(spark, stage):
    from tidewater.llm import simhash

    run = dict(corpus_pipeline.STAGES).get(stage) or (lambda spark, docs, _: simhash.drop_near_copies(docs))
    line = "\n".join(f"shared line {k}" for k in range(3))
    rows = [(i, " ".join(f"w{i % 40}x{j}" for j in range(80)) + "\n" + line, "en", f"src{i % 20}", 0, *[f"{c}{i}" for c in CLASHES]) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    out = run(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert got and all(r[5:] == rows[r[0]][5:] and r[2:4] == rows[r[0]][2:4] for r in got)
    assert len(got) == {"quality_rules": 60, "line_dedup": 60, "near_dedup": 40, "near_copies": 40}.get(stage, len(got))

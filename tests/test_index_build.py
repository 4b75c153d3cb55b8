from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewater.functions.text import python_tokens
from tidewater.operators import fulltext


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(rows):
    """(term, doc_id, field) -> sorted positions."""
    found = defaultdict(list)
    for i, title, text in rows:
        for field, value in (("title", title), ("text", text)):
            for pos, term in enumerate(python_tokens(value or "")):
                found[term, i, field].append(pos)
    return {k: sorted(v) for k, v in found.items()}


ROWS = [(1, "Ä b", "b a B é, e b"), (2, None, ""), (3, "x", None), (4, "a", " -- "), (5, "", "z " * 3000 + "a")]


def built(spark, rows):
    docs = spark.createDataFrame(rows, "id long, title string, text string")
    return fulltext.build(docs, {"title": None, "text": None}, "id")


def check(index, rows):
    got = index.postings.collect()
    assert all(r.tf == len(r.positions) for r in got)
    assert {(r.term, r.doc_id, r.field): r.positions for r in got} == brute(rows)
    assert len(got) == len(brute(rows))
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.doc_len) for r in index.stats.collect())
    assert sizes == sorted((i is None, i or 0, sum(len(python_tokens(x or "")) for x in r)) for i, *r in rows)


def test_postings_are_brute_force_without_a_shuffle_of_tokens(spark):
    index = built(spark, ROWS)
    check(index, ROWS)
    assert "Aggregate" not in plan_of(index.postings)
    assert "regexp_extract_all" not in plan_of(index.postings) + plan_of(index.stats)


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [*ROWS, (1, "b", "a b"), (None, "n", "n m"), (None, "n", "m")]
    check(built(spark, rows), rows)


def test_long_text_is_in_proportion(spark):
    text = spark.range(1).select(F.lit(7).alias("id"), F.lit("").alias("title"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda i: F.concat(F.lit("w"), i % 70_001)), " ").alias("text"))
    index = fulltext.build(text, {"title": None, "text": None}, "id")
    assert index.postings.agg(F.count("*"), F.sum("tf")).first()[:] == (70_001, 300_000)
    assert index.stats.first().doc_len == 300_000


def test_blocks_are_dealt_instead_of_postings(spark, monkeypatch, tmp_path):
    """One term of many documents is few rows to shuffle; parts of a batch, and a text beyond a part, lose nothing."""
    rows = [(i, None if i % 3 else f"Same é{i % 7} e{i % 7}", "same Ünd und " + f"w{i} " * (i % 5)) for i in range(300)]
    rows += [(300, "İ ß Σ ΑΣ", "x" * 9000), (None, "", "same"), (-1, "- , -", None)]
    assert built(spark, rows).blocks.where("term = 'same'").count() < 30
    monkeypatch.setattr(fulltext, "PART", 4000)
    run = fulltext._in_blocks(("title", "text"))
    texts = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "title": [(r[1] or "").lower() for r in rows], "text": [(r[2] or "").lower() for r in rows]})
    made = pa.Table.from_batches(list(run(iter([texts])))).to_pylist()
    got = {(b["term"], i, b["field"]): b["positions"][b["at"][k] : b["at"][k + 1]] for b in made if b["term"] is not None for k, i in enumerate(b["ids"])}
    assert got == brute(rows) and max(len(b["ids"]) for b in made) == fulltext.BLOCK
    assert sum(len(b["ids"]) for b in made if b["term"] is None) == len(rows)
    index = built(spark, rows)
    check(index, rows)
    index.write(str(tmp_path / "i"))
    check(fulltext.Index.read(spark, str(tmp_path / "i"), index.fields), rows)
    for file in (tmp_path / "i" / "postings").glob("*.parquet"):
        terms = pq.read_table(file)["term"].to_pylist()
        assert terms == sorted(terms, key=str.encode)

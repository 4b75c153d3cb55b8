import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.functions.sql import register
from tidewater.functions.text import breadcrumb_text
from tidewater.operators import chunking
from tidewater.operators.chunking import SentenceSplitter, WindowSplitter, chunk
from tidewater.operators.embedding import HashingEmbedder


@pytest.fixture(scope="module")
def docs(spark):
    register(spark, batch=2)
    df = spark.createDataFrame([(1, "# A\n" + "word " * 300), (2, None), (3, ""), (4, "x ![i](p.png)"), (5, "import a\n")], "doc_id long, text string")
    df.createOrReplaceTempView("fn_docs")
    yield df
    spark.catalog.dropTempView("fn_docs")


def test_columns_depend_on_the_kind(spark, docs):
    of = lambda kind: spark.sql(f"SELECT doc_id, c.* FROM fn_docs, LATERAL split_text(text, '{kind}') c")
    assert of("window").columns == ["doc_id", "chunk_index", "start", "end", "cut_type", "is_last", "content"]
    assert {r.doc_id: r.n for r in of("sentence").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 4: 1, 5: 1}
    assert of("markdown").where("doc_id = 4").select("metadata.assets.src").first()[0] == ["p.png"]
    assert of("code").where("doc_id = 5").select("metadata.kind").first()[0] == "statements"
    assert spark.sql("SELECT count(*) FROM fn_docs, LATERAL split_text(text) c").first()[0] == chunk(docs).count()


@pytest.mark.parametrize("call", ["split_text(text, 'none')", "split_text(doc_id)", "split_text(text, text)", "split_text(text, 'window', 0)"])
def test_calls_are_checked_when_analysed(spark, docs, call):
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM fn_docs, LATERAL {call} c")


def test_embedding_functions(spark, docs):
    rows = {r.doc_id: r for r in spark.sql("SELECT * FROM embed_rows(TABLE(fn_docs), 'text')").collect()}
    assert len(rows) == 5 and rows[2].embedding is None and rows[3].embedding is None
    assert rows[4].embedding == pytest.approx(HashingEmbedder().embed([rows[4].text])[0].tolist())
    one = spark.sql("SELECT embed_text(text) AS v FROM fn_docs WHERE doc_id = 4").first().v
    assert one == pytest.approx(rows[4].embedding)
    for call in ("embed_rows(TABLE(fn_docs), 'nope')", "embed_rows(TABLE(fn_docs), 'doc_id')", "embed_rows(TABLE(SELECT text, 1 AS embedding FROM fn_docs), 'text')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}")


@pytest.mark.parametrize("options", [(1000, 200, 100), (10, 9, 9), (7, 0, 3), (50, 10, 0), (5, 2, 30)])
def test_native_windows_equal_the_loop(spark, monkeypatch, options):
    monkeypatch.setattr(chunking, "PIECE", 64)
    r = random.Random(1)
    texts = ["".join(r.choice("abé\n🙂 ") for _ in range(r.randrange(0, 300))) for _ in range(150)]
    splitter = WindowSplitter(*options)
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    got = {(x.doc_id, x.chunk_index): (x.start, x.end, x.cut_type, x.is_last, x.content) for x in chunk(df, splitter=splitter, native=True).collect()}
    assert got == {(i, c.index): (c.start, c.end, c.cut_type, c.is_last, c.text) for i, t in enumerate(texts) for c in splitter.split_text(t)}


def test_native_windows_run_no_python(spark):
    plan = registry.queries()["chunk_native"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        chunk(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), splitter=SentenceSplitter(), native=True)


def test_code_under_its_language(spark):
    df = spark.createDataFrame([("D", "A > B", "x", "py"), ("", "", "y", None), ("D", "", "z", None)], "t string, p string, c string, l string")
    got = [r[0] for r in df.select(breadcrumb_text(F.col("t"), F.col("p"), F.col("c"), F.col("l"))).collect()]
    assert got == ["Document: D\nPath: A > B\nContext: Code Snippet (py)\n---\nx", "y", "Document: D\n---\nz"]

import pytest

from tidewater.operators import fulltext, search
from tidewater.operators.embedding import HashingEmbedder, embed_query
from tidewater.plans.ftsquery import FtsSyntaxError, parse, plain

COLUMNS = ("title", "content")


@pytest.mark.parametrize("text", ["", "как?", "C++", "NOT x", "(a OR b) c", "a AND", "foo:bar", "foo-bar", '"open', "NEAR(a b", "a NEAR(b, c)"])
def test_syntax_errors(text):
    with pytest.raises(FtsSyntaxError):
        parse(text, COLUMNS)


def test_shapes():
    q = parse('title:py* OR "for loop" AND ^x NOT NEAR(a b, 3)', COLUMNS)
    assert [p.terms for p in q.phrases] == [("py",), ("for", "loop"), ("x",), ("a",), ("b",)]
    assert q.phrases[0].prefix and q.phrases[0].columns == ("title",) and q.phrases[2].initial and q.near == [3]
    assert q.root.kind == "or" and q.root.children[1].kind == "and"
    assert parse("-title:a", COLUMNS).phrases[0].columns == ("content",)
    assert [p.terms for p in parse("Ünder_score", COLUMNS).phrases] == [("under", "score")]
    assert len(plain("Was ist das, was?").phrases) == 3


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(1, "Python", "python and java for loop", 1), (2, "Java", "java only the loop", 1), (3, "Gemini", "the Gemini API for python", 2), (4, None, "Café naïve йод ёлка", None), (5, "empty", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, title string, content string, category_id long")


@pytest.fixture(scope="module")
def index(notes):
    return fulltext.build(notes, {"title": None, "content": None})


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("python", {1, 3}),
        ("Gemini API", {3}),
        ("python and java", {1}),
        ("python AND java", {1}),
        ("gemini OR only", {2, 3}),
        ("java NOT python", {2}),
        ("jav*", {1, 2}),
        ('"for loop"', {1}),
        ('"loop for"', set()),
        ("title:java", {2}),
        ("{title content}: gemini", {3}),
        ("-title:java", {1, 2}),
        ("content:^java", {2}),
        ("NEAR(python loop, 3)", {1}),
        ("NEAR(python loop, 2)", set()),
        ("for + loop", {1}),
        ("cafe naive", {4}),
        ("иод OR елка", set()),
        ("(python OR java) AND loop", {1, 2}),
    ],
)
def test_full_text(index, text, ids):
    assert {r.doc_id for r in fulltext.search(index, text).collect()} == ids


def test_facets_and_ranks(notes, index):
    allowed = notes.where(search.facet_filter(notes, {"category_id": 1}))
    out = fulltext.search(index, "python OR loop", 10, allowed).orderBy("rank").collect()
    assert {r.doc_id for r in out} == {1, 2} and [r.rank for r in out] == [1, 2] and out[0].score <= out[1].score
    with pytest.raises(ValueError):
        search.facet_filter(notes, {"1=1; --": 1})
    assert notes.where(search.facet_filter(notes, {"category_id": None})).count() == 0


def test_index_follows_changes(spark, notes, index):
    changed = spark.createDataFrame([(1, "Rust", "borrow checker", 1)], notes.schema)
    gone = spark.createDataFrame([(2,)], "doc_id long")
    now = index.replaced(changed, gone)
    assert {r.doc_id for r in fulltext.search(now, "java").collect()} == set()
    assert {r.doc_id for r in fulltext.search(now, "borrow OR gemini").collect()} == {1, 3}


def test_index_on_disk(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = fulltext.Index.read(spark, str(tmp_path), index.fields)
    rows = lambda x: sorted(map(tuple, fulltext.search(x, '"for loop" OR api').collect()))
    assert rows(again) == rows(index)


def test_vector_and_hybrid(spark, notes, index):
    vectors = spark.createDataFrame([(10, 1, [1.0, 0.0]), (11, 1, [0.0, 1.0]), (12, 2, [0.9, 0.1]), (13, 3, [0.0, 0.0]), (14, 3, [-1.0, 0.0])], "chunk_id long, doc_id long, embedding array<float>")
    out = search.vector_search(notes, vectors, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r.doc_id, r.best_chunk, r.rank) for r in out] == [(1, 10, 1), (2, 12, 2), (3, 14, 3)] and out[2].distance == 2.0
    assert [r.doc_id for r in search.vector_search(notes, vectors, [1.0, 0.0], 1).collect()] == [1]
    assert {r.doc_id for r in search.vector_search(notes, vectors, [1.0, 0.0], facets={"category_id": 2}).collect()} == {3}
    both = search.hybrid_search(notes, vectors, index, [1.0, 0.0], "gemini OR java", 10).orderBy("rank").collect()
    assert {r.doc_id for r in both} == {1, 2, 3} and all(a.score >= b.score for a, b in zip(both, both[1:], strict=False))
    top = search.hydrate(search.hybrid_search(notes, vectors, index, [1.0, 0.0], "gemini"), notes).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and {"title", "content"} <= set(top[0].asDict())


def test_embedder():
    e = HashingEmbedder(16)
    with pytest.raises(ValueError):
        embed_query(e, " \n")
    assert (embed_query(e, "Hello hello") == embed_query(e, "hello")).all()
    assert (e.embed(["?!"]) == 0).all()

    class Broken:
        dimension = 2

        def embed(self, texts, task):
            raise KeyError("down")

    with pytest.raises(RuntimeError):
        embed_query(Broken(), "x")


def test_search_index(spark):
    from tidewater.operators.embedding import HashingEmbedder
    from tidewater.operators.search import SearchIndex, metadata_filter

    rows = [(1, "Python", "Loops", "for loops in python " * 30, {"k": "a"}), (2, "Java", "Arrays", "java arrays and loops " * 30, {"k": "b"}), (3, None, "", "nothing like it", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, title string, text string, metadata map<string,string>")
    index = SearchIndex.build(docs, "text", HashingEmbedder(), context=("lang", "title"), fields=("title",), filters=("lang",))
    assert index.vector("python loops").first().doc_id == 1
    assert [r.doc_id for r in index.fts("title:arrays").collect()] == [2]
    assert {r.doc_id: r.match_type for r in index.hybrid("java arrays").collect()} == {2: "HYBRID", 1: "VECTOR", 3: "VECTOR"}
    assert {r.doc_id for r in index.hybrid("loops", facets={"lang": "Python"}).collect()} == {1}
    with pytest.raises(ValueError):
        index.fts("x", facets={"title": "Loops"})
    assert [r.doc_id for r in metadata_filter(docs, {"k": "b"}).collect()] == [2]


def test_index_rows_without_a_document_are_hidden(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    stale = fulltext.build(docs, {"text": None})
    assert [r.doc_id for r in fulltext.search(stale, "a", 10, docs.where("doc_id = 2")).collect()] == [2]


def test_breadcrumbs_and_assets(spark):
    from pyspark.sql import functions as F

    from tidewater.functions.text import assets, breadcrumb_text, search_text

    df = spark.createDataFrame([("D", "A > B", "x ![i](p/a.png) ![](b.svg \"t\")"), ("", None, "x")], "d string, p string, t string")
    out = df.select(breadcrumb_text(F.col("d"), F.col("p"), F.col("t")).alias("b"), assets(F.col("t")).alias("a"), search_text("d", "p", "t").alias("s")).collect()
    assert out[0].b.startswith("Document: D\nPath: A > B\n---\nx") and out[0].a == ["p/a.png", "b.svg"] and out[1].b == "x"
    assert out[0].s.split("\n")[:2] == ["D", "A > B"] and out[1].s == "x"


@pytest.mark.parametrize("n", [0, 1, 3])
def test_near_is_brute_force(spark, n):
    import itertools
    import random

    rnd = random.Random(n)
    texts = [" ".join(rnd.choice("abcdxyz") for _ in range(rnd.randrange(2, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits, _ = fulltext.matches(fulltext.build(docs, {"text": None}), f'NEAR("a b" c d, {n})')
    got = {r.doc_id: (r.tf0, r.tf1, r.tf2) for r in hits.collect() if r.tf0}
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        at = [[k for k in range(len(w)) if w[k : k + len(p)] == p] for p in (["a", "b"], ["c"], ["d"])]
        part = [set(), set(), set()]
        for combo in itertools.product(*at):
            m = max(combo)
            if all(m - s <= len(p) + n for s, p in zip(combo, (["a", "b"], ["c"], ["d"]), strict=True)):
                for x, s in zip(part, combo, strict=True):
                    x.add(s)
        if part[0]:
            want[i] = tuple(map(len, part))
    assert got == want

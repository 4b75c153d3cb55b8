import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators.chunking import Chunk, MarkdownSplitter, ParagraphSplitter, SentenceSplitter, WindowSplitter, chunk


def spans(text, **options):
    return [(c.start, c.end, c.cut_type, c.is_last) for c in WindowSplitter(**options).split_text(text)]


def test_defaults_and_validation():
    s = WindowSplitter()
    assert (s.chunk_size, s.overlap, s.threshold) == (1000, 200, 100)
    for bad in ({"chunk_size": 0}, {"overlap": -1}, {"chunk_size": 100, "overlap": 100}, {"threshold": -1}):
        with pytest.raises(ValueError):
            WindowSplitter(**bad)


def test_edges():
    assert spans("") == [] and spans(None) == []
    assert spans("short") == [(0, 5, None, True)]
    assert spans("x" * 1040 + "\n") == [(0, 1041, "newline", False), (841, 1041, None, True)]
    assert spans("x" * 1040 + "\n", overlap=0) == [(0, 1041, "newline", False)]
    assert spans("y" * 1500) == [(0, 1000, "hard", False), (800, 1500, None, True)]
    assert spans("a\n" + "b" * 50, chunk_size=10, overlap=9, threshold=9)[:2] == [(0, 2, "newline", False), (1, 11, "hard", False)]


@pytest.mark.parametrize(("size", "least"), [(500, 2), (1500, 2), (3000, 4)])
def test_counts(size, least):
    assert len(spans("z" * size, chunk_size=400, overlap=50)) >= least


@given(st.text(st.sampled_from("ab\n🙂"), max_size=300), st.integers(5, 60), st.integers(0, 4), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, size, overlap, threshold):
    out = list(WindowSplitter(size, overlap, threshold).split_text(text))
    seen = set()
    for i, c in enumerate(out):
        assert c.index == i and c.text == text[c.start : c.end] and c.end - c.start <= size + threshold
        seen.update(range(c.start, c.end))
    assert seen == set(range(len(text)))


def test_repr():
    assert repr(Chunk(0, 0, 5, None, True, "short")) == "Chunk(index=0, text='short')"
    assert repr(Chunk(1, 0, 60, None, True, "x" * 60)).endswith("x...')")


def test_other_splitters():
    text = "a" * 120 + "\n\nshort\n\n" + "b" * 150
    assert [(c.start, c.end) for c in ParagraphSplitter().split_text(text)] == [(0, 120), (129, 279)]
    sentences = list(SentenceSplitter(20).split_text("One two three. Four five six! Seven? Eight"))
    assert "".join(c.text for c in sentences) == "One two three. Four five six! Seven? Eight" and len(sentences) > 1
    md = "# A\ntext\n## B\n```\n# no heading\n" + "code\n" * 30 + "```\n## C\nend"
    out = list(MarkdownSplitter(60).split_text(md))
    assert [c.cut_type for c in out] == ["A", "A > B", "A > C"] and "".join(c.text for c in out) == md


def test_frame(spark):
    docs = spark.createDataFrame([(1, "x" * 2500, "a"), (2, None, "b"), (3, "", "c")], "id long, body string, content string")
    out = chunk(docs, "id", "body").orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index, r.start, r.end) for r in out] == [(1, 0, 0, 1000), (1, 1, 800, 1800), (1, 2, 1600, 2500)]


def test_hierarchy(spark):
    from tidewater.operators.chunking import HierarchicalSplitter, WindowSplitter, chunk, with_parents

    text = "".join(f"line {i}\n" for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "doc_id long, text string")
    rows = with_parents(chunk(docs, splitter=HierarchicalSplitter()), docs).collect()
    assert all(r.content == {1: text, 2: "short"}[r.doc_id][r.start : r.end] and r.content in r.parent_content for r in rows)
    parents = {r.parent_content for r in rows if r.doc_id == 1}
    assert parents == {c.text for c in WindowSplitter(2000, 0, 200).split_text(text)} and [r.content for r in rows if r.doc_id == 2] == ["short"]


def test_files_are_split_by_their_kind(spark, tmp_path):
    from tidewater.sources.files import chunk_files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a_b.md").write_text("# One\nx\n## Two\ny\n")
    (tmp_path / "sub" / "c.txt").write_text("plain " * 300)
    (tmp_path / "d.pdf").write_text("no")
    rows = chunk_files(spark, str(tmp_path)).collect()
    assert sorted((r.title, r.chunk_index, r.cut_type) for r in rows if r.title == "A B") == [("A B", 0, "One"), ("A B", 1, "One > Two")]
    assert {r.title for r in rows} == {"A B", "C"} and sum(r.title == "C" for r in rows) == 2


def test_markdown_sql_on_headings():
    """The registered SQL on texts with headings and code, of which the test tables have hardly any."""
    import hashlib

    import duckdb

    from tidewater import registry

    texts = [
        "# A\nx\n## B\ny\n# C\nz", "", "\n", "#\nempty title\n####### seven\n###### six",
        "intro\n# T\n```\n# not\n```\n## U\n" + "w " * 700 + "\n### V\n" + "line of text\n" * 200,
        "```\n# in\n" + "q" * 2000 + "\n```\nrest\n# R\n" + "r" * 1500,
    ]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted((i, x.index, x.start, x.end, x.cut_type, x.is_last, hashlib.md5(x.text.encode()).hexdigest()) for i, t in enumerate(texts) for x in MarkdownSplitter().split_text(t))
    assert sorted(c.execute(registry.oracle_sql()["markdown_chunks"]).fetchall()) == want and sum(bool(r[4]) for r in want) > 5

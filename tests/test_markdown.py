import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators.chunking import chunk
from tidewater.operators.markdown import MarkdownBlockSplitter, blocks

CASES = [
    ("# A\ntext\n", [("heading", "# A\n", 0), ("paragraph", "text\n", 0)]),
    ("Title\n=====\nx\n\nSub\nline\n---\n", [("heading", "Title\n=====\n", 0), ("paragraph", "x\n", 0), ("heading", "Sub\nline\n---\n", 0)]),
    ("~~~py x\n# no\n```\n~~~\n# yes ##\n", [("code", "~~~py x\n# no\n```\n~~~\n", 0), ("heading", "# yes ##\n", 0)]),
    ("````\n```\n# in\n````\nout", [("code", "````\n```\n# in\n````\n", 0), ("paragraph", "out", 0)]),
    ("```\nnever closed\n# in", [("code", "```\nnever closed\n# in", 0)]),
    ("- a\n  ```sh\n  # in\n  ```\n- b\n\nend\n", [("paragraph", "- a\n", 1), ("code", "  ```sh\n  # in\n  ```\n", 1), ("paragraph", "- b\n", 1), ("paragraph", "end\n", 0)]),
    ("- ```\n  in\nout\n", [("code", "- ```\n  in\n", 1), ("paragraph", "out\n", 0)]),
    ("> quote\nlazy\n> # h\n\nx\n", [("paragraph", "> quote\nlazy\n", 1), ("heading", "> # h\n", 1), ("paragraph", "x\n", 0)]),
    ("> - deep\n>   more\n> out\n", [("paragraph", "> - deep\n>   more\n> out\n", 2)]),
    ("    code\n\n    more\n\ntext\n", [("code", "    code\n\n    more\n", 0), ("paragraph", "text\n", 0)]),
    ("text\n    no code\n", [("paragraph", "text\n    no code\n", 0)]),
    ("a | b\n--|--\n1 | 2\n\nx\n", [("table", "a | b\n--|--\n1 | 2\n", 0), ("paragraph", "x\n", 0)]),
    ("a\n* * *\n---\n_ _ _\n", [("paragraph", "a\n", 0), ("rule", "* * *\n", 0), ("rule", "---\n", 0), ("rule", "_ _ _\n", 0)]),
    ("a\n2. no item\n1. item\n", [("paragraph", "a\n2. no item\n", 0), ("paragraph", "1. item\n", 1)]),
    ("<!--\n# in\n-->\n<pre>x</pre>\n# h", [("raw", "<!--\n# in\n-->\n", 0), ("raw", "<pre>x</pre>\n", 0), ("heading", "# h", 0)]),
    ("#no\n####### seven\n#\n", [("paragraph", "#no\n####### seven\n", 0), ("heading", "#\n", 0)]),
    ("\t# code\n", [("code", "\t# code\n", 0)]),
    ("\r\n# A\r\nx\r\n", [("heading", "# A\r\n", 0), ("paragraph", "x\r\n", 0)]),
    ("", []), ("\n \n", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_blocks(text, want):
    assert [(b.kind, text[b.start : b.end], b.depth) for b in blocks(text)] == want


def test_titles_and_languages():
    found = list(blocks("# A #\n## B # c\n### ##\nTwo\n lines\n===\n```  py title=x\n```\n~~~\n~~~\n"))
    assert [(b.level, b.title) for b in found if b.kind == "heading"] == [(1, "A"), (2, "B # c"), (3, ""), (1, "Two lines")]
    assert [b.language for b in found if b.kind == "code"] == ["py", None]


def split(text, **options):
    return [(c.cut_type, c.text, c.metadata["is_code"], c.metadata["language"], [a["src"] for a in c.metadata["assets"]]) for c in MarkdownBlockSplitter(**options).split_text(text)]


def test_small_sections_are_packed():
    text = "".join(f"# S{i}\nline\n" for i in range(50))
    out = split(text)
    assert len(out) < 5 and "".join(c[1] for c in out) == text and all(c[0] == "" for c in out[:-1])
    assert [c[0] for c in split("# D\n" + "".join(f"## S{i}\nline\n" for i in range(20)))] == ["D"]
    assert len(split(text, least=0)) == 50


def test_code_stays_apart_and_is_cut_only_when_too_long():
    text = "# A\n\nintro\n\n```py\n" + "x = 1\n" * 100 + "```\n\nafter ![alt](a.png)\n\n## B\n```\n" + "word " * 3 + "\n" * 20_000 + "```\n"
    out = split(text)
    assert [(c[0], c[2], c[3], c[4]) for c in out[:3]] == [("A", False, None, []), ("A", True, "py", []), ("A", False, None, ["a.png"])]
    assert len(out) > 12 and all(c[0] == "A > B" and c[2] for c in out[3:]) and max(len(c[1]) for c in out) <= 1500
    long = split("# P\n" + "word " * 1000 + "![x](b.png)\n")
    assert len(long) > 4 and all(c[0] == "P" and c[4] == ["b.png"] for c in long)


def test_validation():
    for bad in ({"chunk_size": 0}, {"least": -1}):
        with pytest.raises(ValueError):
            MarkdownBlockSplitter(**bad)


LINES = st.lists(st.sampled_from(["# a", "## b", "text", "", "```", "~~~", "- x", "  y", "> q", "    c", "---", "===", "a|b", "-|-", "1. z", "<!--", "-->", "\tt", "![i](s)"]), max_size=40).map("\n".join)


@given(LINES, st.integers(1, 60), st.integers(0, 60))
@settings(max_examples=300, deadline=None)
def test_chunks_are_in_order_and_lose_no_text(text, size, least):
    at, covered = 0, set()
    for i, c in enumerate(MarkdownBlockSplitter(size, least).split_text(text)):
        assert c.index == i and c.start >= at and c.text == text[c.start : c.end]
        at = c.end
        covered.update(range(c.start, c.end))
    assert all(text[i].isspace() or text[i] == ">" for i in set(range(len(text))) - covered)
    ends = [(b.start, b.end) for b in blocks(text)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "# A\n![p](i.png)\n```sh\nls\n```\n", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, metadata string")
    rows = chunk(docs, splitter=MarkdownBlockSplitter()).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.cut_type, r.is_last, r.metadata.asDict(True)) for r in rows] == [
        (1, "A", False, {"headers": ["A"], "assets": [{"src": "i.png", "alt": "p"}], "is_code": False, "language": None}),
        (1, "A", True, {"headers": ["A"], "assets": [], "is_code": True, "language": "sh"}),
    ]

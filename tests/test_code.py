import ast
import random

import pytest

from tidewater.operators.chunking import chunk
from tidewater.operators.code import CodeSplitter

SOURCE = '''"""Module."""
import os
from a import (
    b as c,
)

X = 1; Y = 2

# about f
@deco
@other(1)
def f(x):
    return os.path

class Small:
    pass


async def g():
    await c


class Big(Base):
    """Doc."""

    z = 3

    # about h
    def h(self):
        return "%s"

    @property
    def i(self): return 1

if X:
    import late
'''


def split(text, **options):
    return [(c.cut_type, c.metadata["kind"], text[c.start : c.end], c.metadata["imports"]) for c in CodeSplitter(**options).split_text(text)]


def test_units_and_imports():
    text = SOURCE % ("v" * 900)
    out = split(text)
    imports = "import os\nfrom a import (\n    b as c,\n)\n"
    assert [(n, k) for n, k, _, _ in out] == [(None, "statements"), ("f", "function"), ("Small", "class"), ("g", "function"), ("Big", "class"), ("Big.h", "function"), ("Big.i", "function"), (None, "statements")]
    assert "".join(t for _, _, t, _ in out) == text
    assert [i for *_, i in out] == ["", *[imports] * 7]
    assert out[1][2].startswith("\n# about f\n@deco") and out[4][2].endswith("z = 3\n") and out[5][2].startswith("\n    # about h\n")
    small = split(SOURCE % "v")
    assert [n for n, *_ in small] == [None, "f", "Small", "g", "Big", None]
    assert next(iter(CodeSplitter().split_text("import a\ndef f(): pass"))).text == "import a\n"
    assert [c.text for c in CodeSplitter().split_text("def f(): pass\nimport a")] == ["import a\ndef f(): pass\n", "import a"]


def test_what_does_not_parse():
    assert split("def (:\n") == [(None, "text", "def (:\n", "")]
    assert [k for _, k, _, _ in split("x =\n" * 500)] == ["text"] * 2
    assert split("") == [] and list(CodeSplitter().split_text(None)) == []
    assert split("# only a comment\n") == [(None, "text", "# only a comment\n", "")]
    assert split("a\0b") == [(None, "text", "a\0b", "")]
    assert [k for _, k, _, _ in split("(" * 5000)] == ["text"] * 5
    with pytest.raises(ValueError):
        CodeSplitter(0)


def test_large_functions_are_cut_at_lines():
    text = "import a\ndef f():\n" + "    x = 1\n" * 400
    out = split(text)
    assert "".join(t for _, _, t, _ in out) == text and {n for n, *_ in out[1:]} == {"f"} and len(out) > 3
    assert all(t.endswith("\n") and len(t) <= 1500 for _, _, t, _ in out) and all(i == "import a\n" for *_, i in out[1:])


@pytest.mark.parametrize("seed", range(30))
def test_random_modules(seed):
    """Pieces make up the text, every definition is whole in one piece, and every other piece has all imports."""
    r = random.Random(seed)

    def body(depth, indent):
        out = []
        for i in range(r.randrange(1, 5)):
            kind = r.randrange(6 if depth < 3 else 3)
            pad = " " * indent
            out.append({0: f"{pad}x{i} = {i}\n", 1: f"{pad}import m{i}\n", 2: f"{pad}# note\r\n{pad}y = 1; z = (\n1,\n)\n"}.get(kind) or (pad + r.choice(["@d\n" + pad, ""]) + (f"class C{i}:\n" if kind == 3 else r.choice(["", "async "]) + f"def f{i}():\n") + body(depth + 1, indent + 2)))
            out.append(r.choice(["", "\n", "\n\n"]))
        return "".join(out)

    text = body(0, 0)
    tree = ast.parse(text)
    size = r.choice([20, 100, 1000])
    out = split(text, chunk_size=size)
    assert "".join(t for _, _, t, _ in out) == text
    names = {n for n, k, _, _ in out if k == "function"}
    assert {n.name for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)} <= names
    if size == 1000:
        for n, k, t, _ in out:
            if k in ("function", "class") and "." not in n:
                ast.parse(t)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "import a\ndef f():\n    pass\n"), (2, None)], "doc_id long, text string")
    rows = chunk(docs, splitter=CodeSplitter()).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.content, r.metadata.name, r.metadata.kind) for r in rows] == [(0, "import a\n", None, "statements"), (1, "import a\ndef f():\n    pass\n", "f", "function")]

"""Text expressions: tokens, context, previews."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of a chunk's context, part of the embedded text.
CATEGORY_LABEL, TITLE_LABEL = "Категория: ", "Заголовок: "

#: Letters that lose their diacritics: lower-case Latin ones whose decomposition starts with an ASCII letter.
_FOLDED = [(c, d) for c in map(chr, range(0x00C0, 0x0250)) if c.islower() and (d := unicodedata.normalize("NFD", c)[0]).isascii() and c != d]
FOLD_FROM, FOLD_TO = "".join(c for c, _ in _FOLDED), "".join(d for _, d in _FOLDED)
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column | str) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column | str) -> Column:
    """Folded runs of letters and digits; null gives none."""
    return F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit(TOKEN), F.lit(0))


_FOLDING = str.maketrans(FOLD_FROM, FOLD_TO)


def folded(low: str) -> str:
    """A string in lower case without the diacritics that fold() takes."""
    return low if low.isascii() else low.translate(_FOLDING)


@cache
def _token():
    import regex

    return regex.compile(TOKEN)


def python_tokens(text: str) -> list[str]:
    """The same for a string in Python: queries on the driver, texts in workers."""
    return _token().findall(folded(text.lower()))


def context_text(category: Column, title: Column) -> Column:
    """Labelled category and title, each if there is one, on lines of their own."""
    return F.concat_ws("\n", F.when(category.isNotNull(), F.concat(F.lit(CATEGORY_LABEL), category)), F.when(title.isNotNull() & (title != ""), F.concat(F.lit(TITLE_LABEL), title)))


def vector_text(context: Column, chunk: Column) -> Column:
    """What is embedded for a chunk."""
    return F.when(context != "", F.concat(context, F.lit("\n\n"), chunk)).otherwise(chunk)


def search_text(*parts: Column | str) -> Column:
    """A row's text to search by: its parts that there are, in order, on lines of their own."""
    each = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n", *[F.when(p != "", p) for p in each])


def breadcrumb_text(title: Column, path: Column, text: Column, language: Column | None = None) -> Column:
    """A section's text under its document and path of headings (`A > B`); code also under its language, if that is known."""
    lines = [F.concat(F.lit("Document: "), F.when(title != "", title)), F.concat(F.lit("Path: "), F.when(path != "", path))]
    if language is not None:
        lines.append(F.concat(F.lit("Context: Code Snippet ("), F.when(language != "", language), F.lit(")")))
    head = F.concat_ws("\n", *lines)
    return F.when(head != "", F.concat(head, F.lit("\n---\n"), text)).otherwise(text)


def assets(markdown: Column) -> Column:
    """The targets of a Markdown text's images, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))


def preview(text: Column | str, n: int = 80) -> Column:
    """The first n characters on one line, with dots."""
    return F.concat(F.translate(F.substring(text, 1, n), "\n", " "), F.lit("..."))


def title_of(file_name: Column) -> Column:
    """A file's stem as a title: underscores are spaces, and a word starts after any non-letter."""
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    words = F.regexp_extract_all(F.lower(F.translate(stem, "_", " ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")

"""Queries over structured texts, Markdown and source code, which Spark derives from the lines of `documents`.

The SQL doesn't parse: it knows each block from the rule that made it, so parser and rule are held against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import chunking
from tidewater.operators.code import CodeSplitter
from tidewater.operators.markdown import MarkdownBlockSplitter

#: A line as words of letters, and a title of it. The same expressions are read by Spark and by DuckDB.
_WORDS = r"coalesce(nullif(trim(regexp_replace(line, '[^\p{L} ]', ''%s)), ''), 'x')"
_MARKDOWN = """
CASE k % 9 WHEN 0 THEN repeat('#', CAST(1 + k / 9 % 3 AS INT)) || ' ' || title
  WHEN 1 THEN words
  WHEN 2 THEN '```py' || chr(10) || '# ' || words || chr(10) || '```'
  WHEN 3 THEN '~~~' || chr(10) || '```' || chr(10) || words || chr(10) || '~~~'
  WHEN 4 THEN '> ' || words
  WHEN 5 THEN '- ' || words || chr(10) || chr(10) || '  ```sh' || chr(10) || '  ' || title || chr(10) || '  ```'
  WHEN 6 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || title || ' | ' || words || ' |'
  WHEN 7 THEN title || chr(10) || '---'
  ELSE '![' || title || '](img/' || CAST(k AS STRING) || '.png) ' || words END || chr(10) || chr(10)"""
_CODE = """
CASE WHEN k = 0 AND doc_id % 7 = 3 THEN 'def (:' || chr(10) ELSE '' END || CASE WHEN k % 6 = 0 THEN 'import m' || CAST(k AS STRING) || chr(10)
  WHEN k % 6 = 1 THEN '# ' || words || chr(10) || '@wrapped' || chr(10) || 'def f' || CAST(k AS STRING) || '(x):' || chr(10) || '    return "' || words || '"' || chr(10) || chr(10)
  WHEN k % 6 = 2 THEN 'a' || CAST(k AS STRING) || ' = "' || title || '"' || chr(10)
  WHEN k % 6 = 3 THEN 'b' || CAST(k AS STRING) || ' = 1; c = 2' || chr(10)
  WHEN k % 6 = 4 THEN 'class C' || CAST(k AS STRING) || ':' || chr(10) || '    ' || repeat(chr(34), 3) || title || repeat(chr(34), 3) || chr(10) || chr(10) || '    x = 1' || chr(10) || chr(10) || '    def g(self):' || chr(10) || '        return "' || words || '"' || chr(10) || chr(10) || '    async def h(self):' || chr(10) || '        pass' || chr(10)
  ELSE 'from n' || CAST(k AS STRING) || ' import (' || chr(10) || '    y as z,' || chr(10) || ')' || chr(10) END"""


def _spark(rule: str) -> str:
    return rule.replace("k / 9", "k div 9").replace("\\", "\\\\")


def derived(docs: DataFrame, rule: str) -> DataFrame:
    """doc_id, text: the texts' lines, each rewritten by a rule over k, words and title."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    named = lines.withColumn("words", F.expr(_spark(_WORDS % ""))).withColumn("title", F.expr("trim(substr(words, 1, 20))"))
    made = named.withColumn("made", F.expr(_spark(rule)))
    return made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "made"))), lambda x: x["made"]), "").alias("text"))


_LINES = rf"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
w AS (SELECT doc_id, k, {_WORDS % ", 'g'"} AS words FROM l), t AS (SELECT *, trim(substr(words, 1, 20)) AS title FROM w)"""


def _windows(source: str, half: str) -> str:
    """Rows of `source` (doc_id, a, b, body, size and more) cut at 1000 by newlines at most `half` away, as (s, e)."""
    low, high = f"greatest(s, s + 1000 - {half})", f"least(size, s + 1000 + {half})"
    back = f"strpos(reverse(substr(body, {low} + 1, {high} - {low})), chr(10))"
    cut = f"CASE WHEN {back} > 0 THEN {high} - {back} + 1 ELSE s + 1000 END"
    return f"""
  SELECT *, 0::BIGINT AS s, CASE WHEN size <= 1000 THEN size END AS e FROM {source}
  UNION ALL
  SELECT * EXCLUDE (s, e), s, CASE WHEN s + 1000 >= size THEN size END FROM (SELECT * EXCLUDE (s, e), greatest(s + 1, {cut}) AS s, 0 AS e FROM cuts WHERE s + 1000 < size) WHERE s < size""", f"coalesce(e, {cut})"


_CUTS, _END = _windows("sized", "CASE WHEN is_code THEN 500 ELSE 100 END")
MARKDOWN_SQL = f"""
WITH RECURSIVE {_LINES},
m AS (SELECT *, {_MARKDOWN.replace("k / 9", "k // 9")} AS made FROM t),
p AS (SELECT *, coalesce(sum(length(made)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m),
b AS (
  SELECT doc_id, 2 * k AS o, pos, pos + CASE WHEN k % 9 = 5 THEN length(words) + 3 ELSE length(made) - 1 END AS stop, k % 9 IN (2, 3) AS is_code, CASE WHEN k % 9 = 2 THEN 'py' END AS language,
    CASE k % 9 WHEN 0 THEN 1 + k // 9 % 3 WHEN 7 THEN 2 END AS level, title, CASE WHEN k % 9 = 8 THEN 'img/' || k || '.png' END AS src FROM p
  UNION ALL SELECT doc_id, 2 * k + 1, pos + length(words) + 4, pos + length(made) - 1, true, 'sh', NULL, title, NULL FROM p WHERE k % 9 = 5),
h AS (
  SELECT *, lag(CASE WHEN level IS NOT NULL THEN pos END) OVER r AS before, lead(o) OVER r IS NULL AS final,
    max(CASE WHEN level = 1 THEN o END) OVER r AS h1, max(CASE WHEN level = 2 THEN o END) OVER r AS h2, max(CASE WHEN level = 3 THEN o END) OVER r AS h3
  FROM b WINDOW r AS (PARTITION BY doc_id ORDER BY o)),
n AS (SELECT doc_id, o, title FROM b WHERE level IS NOT NULL),
g AS MATERIALIZED (
  SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.o) AS i, coalesce(before, pos) AS pos, stop, is_code, language, src,
    list_filter([n1.title, n2.title, n3.title], lambda x: x IS NOT NULL) AS path
  FROM h LEFT JOIN n n1 ON n1.doc_id = h.doc_id AND n1.o = h1 LEFT JOIN n n2 ON n2.doc_id = h.doc_id AND n2.o = h2 AND h2 > coalesce(h1, -1)
    LEFT JOIN n n3 ON n3.doc_id = h.doc_id AND n3.o = h3 AND h3 > greatest(coalesce(h1, -1), coalesce(h2, -1))
  WHERE level IS NULL OR final),
pack AS (
  SELECT doc_id, i, pos, stop, is_code, language, path, 1::BIGINT AS c FROM g WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN j THEN was ELSE pos END, stop, is_code, language, CASE WHEN j THEN shared ELSE path END, CASE WHEN j THEN c ELSE c + 1 END FROM (
    SELECT g.*, k.pos AS was, k.c, NOT k.is_code AND NOT g.is_code AND g.stop - k.pos <= 1000 AND (g.path = k.path OR k.stop - k.pos < 250) AS j,
      list_filter(k.path, lambda x, q: list_slice(k.path, 1, q) = list_slice(g.path, 1, q)) AS shared
    FROM pack k JOIN g ON g.doc_id = k.doc_id AND g.i = k.i + 1)),
chunk AS (SELECT doc_id, c, arg_max(struct_pack(pos, stop, is_code, language, path), i) AS x FROM pack GROUP BY doc_id, c),
whole AS (SELECT doc_id, string_agg(made, '' ORDER BY k) AS text FROM m GROUP BY doc_id),
sized AS (SELECT doc_id, x.pos AS a, x.stop - x.pos AS size, substr(text, x.pos + 1, x.stop - x.pos) AS body, x.is_code AS is_code, x.language AS language, x.path AS path FROM chunk JOIN whole USING (doc_id)),
cuts AS ({_CUTS}),
f AS (SELECT *, a + s AS start, a + {_END} AS "end" FROM cuts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::BIGINT AS chunk_index, start::BIGINT AS start, "end"::BIGINT AS "end", array_to_string(path, ' > ') AS headers,
  coalesce((SELECT string_agg(src, ',' ORDER BY pos) FROM b WHERE b.doc_id = f.doc_id AND b.src IS NOT NULL AND b.pos >= f.a AND b.pos < f.a + f.size), '') AS assets,
  is_code, language, md5(substr(body, s + 1, "end" - start)) AS content_md5
FROM f
"""


def markdown_blocks(spark, sf_dir: str) -> DataFrame:
    """Markdown notes, a block a line of a document, as chunks of whole blocks with their headings and images."""
    notes = derived(spark.read.parquet(f"{sf_dir}/documents.parquet"), _MARKDOWN)
    out = chunking.chunk(notes, splitter=MarkdownBlockSplitter())
    more = [F.array_join("metadata.headers", " > ").alias("headers"), F.array_join(F.transform("metadata.assets", lambda a: a["src"]), ",").alias("assets"), F.col("metadata.is_code").alias("is_code"), F.col("metadata.language").alias("language")]
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], *more, F.md5("content").alias("content_md5"))


_CODE_CUTS, _CODE_END = _windows("sized", "500")
CODE_SQL = f"""
WITH RECURSIVE {_LINES},
m AS (SELECT *, {_CODE} AS made FROM t),
p AS (SELECT *, coalesce(sum(length(made)) OVER r, 0)::BIGINT AS pos, lead(k) OVER (PARTITION BY doc_id ORDER BY k) IS NULL AS final FROM m WINDOW r AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT doc_id, string_agg(made, '' ORDER BY k) AS text FROM m GROUP BY doc_id),
c AS (SELECT *, k % 6 AS kind, pos + length(made) AS stop, length(title) + 31 + length(k::VARCHAR) AS head, length(title) + 67 + length(k::VARCHAR) + length(words) AS g FROM p WHERE doc_id % 7 <> 3),
u AS (
  SELECT doc_id, min(CASE WHEN kind = 2 THEN pos - 1 ELSE pos END) AS a, max(stop) AS b, 'statements' AS kind, NULL AS name FROM c WHERE kind IN (0, 2, 3, 5) GROUP BY doc_id, CASE kind WHEN 3 THEN k - 1 WHEN 0 THEN k - 1 ELSE k END
  UNION ALL SELECT doc_id, pos, CASE WHEN final THEN stop ELSE stop - 1 END, 'function', 'f' || k FROM c WHERE kind = 1
  UNION ALL SELECT doc_id, pos, stop, 'class', 'C' || k FROM c WHERE kind = 4 AND length(made) <= 1000
  UNION ALL SELECT doc_id, pos, pos + head, 'class', 'C' || k FROM c WHERE kind = 4 AND length(made) > 1000
  UNION ALL SELECT doc_id, pos + head, pos + g, 'function', 'C' || k || '.g' FROM c WHERE kind = 4 AND length(made) > 1000
  UNION ALL SELECT doc_id, pos + g, stop, 'function', 'C' || k || '.h' FROM c WHERE kind = 4 AND length(made) > 1000
  UNION ALL SELECT doc_id, 0, length(text), 'text', NULL FROM whole WHERE doc_id % 7 = 3),
sized AS (SELECT doc_id, a, b - a AS size, substr(text, a + 1, b - a) AS body, kind, name FROM u JOIN whole USING (doc_id)),
cuts AS ({_CODE_CUTS}),
f AS (SELECT *, a + s AS start, a + {_CODE_END} AS "end" FROM cuts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::BIGINT AS chunk_index, start::BIGINT AS start, "end"::BIGINT AS "end", kind, name,
  md5(coalesce((SELECT string_agg(made, '' ORDER BY k) FROM c WHERE c.doc_id = f.doc_id AND c.kind IN (0, 5) AND NOT (c.pos >= start AND c.pos < "end")), '') || substr(body, s + 1, "end" - start)) AS content_md5
FROM f
"""


def code_chunks(spark, sf_dir: str) -> DataFrame:
    """Source code, a statement or definition a line of a document, as chunks by its syntax; one file in seven doesn't parse."""
    files = derived(spark.read.parquet(f"{sf_dir}/documents.parquet"), _CODE)
    out = chunking.chunk(files, splitter=CodeSplitter())
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "metadata.kind", "metadata.name", F.md5("content").alias("content_md5"))

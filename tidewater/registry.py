"""All queries over the test tables, by name, and the SQL that gives the same rows.

`documents` stand for notes (text: content, source: title, lang: category), `embeddings` for chunk vectors (vec_id is
the chunk's id, PARENTS of them share documents). Rows are ranked by whole distances and scores; six digits are shown.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import structured
from tidewater.functions import text as tx
from tidewater.functions import vectors as vx
from tidewater.operators import chunking, fulltext, fusion, search, store
from tidewater.operators.embedding import HashingEmbedder, QueryCache, embed_column, embed_query, try_embed_column
from tidewater.sources.shared import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PARENTS = 150


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# chunks

_LO, _HI = "greatest(s, s + 900)", "least(n, s + 1100)"
_BACK = f"strpos(reverse(substr(text, {_LO} + 1, {_HI} - {_LO})), chr(10))"
_CUT = f"CASE WHEN {_BACK} > 0 THEN {_HI} - {_BACK} + 1 ELSE s + 1000 END"
CHUNKS = f"""
RECURSIVE walk AS (
  SELECT doc_id, text, length(text) AS n, 0 AS i, 0::BIGINT AS s FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, n, i + 1, greatest(s + 1, {_CUT} - 200) FROM walk WHERE s + 1000 < n AND greatest(s + 1, {_CUT} - 200) < n),
chunks AS (
  SELECT doc_id, i AS chunk_index, s AS start, CASE WHEN s + 1000 >= n THEN n ELSE {_CUT} END AS "end",
    CASE WHEN s + 1000 >= n THEN NULL WHEN {_BACK} > 0 THEN 'newline' ELSE 'hard' END AS cut_type, s + 1000 >= n AS is_last, text
  FROM walk),
cut AS (SELECT *, substr(text, start + 1, "end" - start) AS content FROM chunks)
"""


@query(f'WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, start::BIGINT AS start, "end"::BIGINT AS "end", cut_type, is_last, md5(content) AS content_md5 FROM cut')
def chunk_documents(spark, sf_dir):
    out = chunking.chunk(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "cut_type", "is_last", F.md5("content").alias("content_md5"))


_SPANS = ORACLES["chunk_documents"]


@query(_SPANS)
def chunk_native(spark, sf_dir):
    """The same chunks without Python workers."""
    out = chunking.chunk(table(spark, sf_dir, "documents"), native=True)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "cut_type", "is_last", F.md5("content").alias("content_md5"))


@query(_SPANS)
def chunk_sql(spark, sf_dir):
    """The same chunks by a table function in a statement."""
    from tidewater.functions.sql import register

    register(spark)
    statement = """
    SELECT doc_id, CAST(c.chunk_index AS LONG) AS chunk_index, CAST(c.start AS LONG) AS start, CAST(c.`end` AS LONG) AS `end`, c.cut_type, c.is_last, md5(c.content) AS content_md5
    FROM {documents}, LATERAL split_text(text, 'window', 1000) c"""
    return spark.sql(statement, documents=table(spark, sf_dir, "documents"))


query(structured.MARKDOWN_SQL)(structured.markdown_blocks)
query(structured.CODE_SQL)(structured.code_chunks)


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM documents) AS n_documents, count(*) AS n_chunks, round((SELECT avg(length(text)) FROM documents), 6) AS avg_chars, round(count(*) / (SELECT count(*) FROM documents), 6) AS avg_chunks FROM cut")
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.statistics(docs, chunking.chunk(docs))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index::BIGINT AS chunk_index, translate(substr(content, 1, 80), chr(10), ' ') || '...' AS preview FROM cut WHERE chunk_index < 3")
def chunk_preview(spark, sf_dir):
    return chunking.listing(chunking.chunk(table(spark, sf_dir, "documents"))).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, max(length(content))::BIGINT AS longest FROM cut GROUP BY doc_id")
def chunks_per_document(spark, sf_dir):
    return chunking.chunk(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).cast("long").alias("longest"))


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS content, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents),
k AS (SELECT * FROM p WHERE length(content) > 100)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk_index, md5(content) AS content_md5 FROM k""")
def paragraph_chunks(spark, sf_dir):
    out = chunking.chunk(table(spark, sf_dir, "documents"), splitter=chunking.ParagraphSplitter())
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


@query(r"""
WITH RECURSIVE s AS (SELECT doc_id, text, length(text) AS n, regexp_extract_all(text, '(?s).*?[.!?]+\s+|.+') AS parts FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, text, n, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT) AS ends FROM s),
walk AS (
  SELECT doc_id, text, n, ends, -1::BIGINT AS i, 0::BIGINT AS s, 0::BIGINT AS e FROM e
  UNION ALL
  SELECT doc_id, text, n, ends, i + 1, e, coalesce(list_max(list_filter(ends, lambda x: x > walk.e AND x <= walk.e + 1000)), list_min(list_filter(ends, lambda x: x > walk.e))) FROM walk WHERE e < n)
SELECT doc_id, i AS chunk_index, s AS start, e AS "end", CASE WHEN e < n THEN 'sentence' END AS cut_type, e >= n AS is_last, md5(substr(text, s + 1, e - s)) AS content_md5
FROM walk WHERE i >= 0""")
def sentence_chunks(spark, sf_dir):
    out = chunking.chunk(table(spark, sf_dir, "documents"), splitter=chunking.SentenceSplitter())
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "cut_type", "is_last", F.md5("content").alias("content_md5"))


@query(rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k, len(string_split(text, chr(10))) AS m FROM documents),
p AS (
  SELECT doc_id, line || CASE WHEN k < m THEN chr(10) ELSE '' END AS line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
    sum(starts_with(line, '```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) % 2 = 0 AS plain
  FROM l),
h AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,6}})\s+', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\s+([^\n]*)', 1)) AS title FROM p WHERE plain AND regexp_matches(line, '^#{{1,6}}\s')),
a AS (SELECT doc_id, pos, level FROM h UNION ALL SELECT doc_id, 0, 0 FROM documents),
b AS (SELECT a.*, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos, level), length(text)) AS stop, text AS whole FROM a JOIN documents USING (doc_id)),
c AS (
  SELECT b.doc_id, b.pos, string_agg(h.title, ' > ' ORDER BY h.pos) AS crumbs FROM b JOIN h ON h.doc_id = b.doc_id AND h.pos <= b.pos AND b.level > 0
  WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = h.doc_id AND k.pos > h.pos AND k.pos <= b.pos AND k.level <= h.level) GROUP BY b.doc_id, b.pos),
z AS (SELECT b.doc_id, b.pos, CASE WHEN b.level > 0 THEN crumbs ELSE '' END AS crumbs, substr(whole, b.pos + 1, b.stop - b.pos) AS text, b.stop - b.pos AS n FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.pos = b.pos),
walk AS (
  SELECT doc_id, pos, crumbs, text, n, 0::BIGINT AS s FROM z WHERE n > 1000 AND NOT contains(text, '```')
  UNION ALL
  SELECT doc_id, pos, crumbs, text, n, greatest(s + 1, {_CUT}) FROM walk WHERE s + 1000 < n AND greatest(s + 1, {_CUT}) < n),
y AS (
  SELECT doc_id, pos + s AS start, pos + CASE WHEN s + 1000 >= n THEN n ELSE {_CUT} END AS "end", crumbs, substr(text, s + 1, CASE WHEN s + 1000 >= n THEN n ELSE {_CUT} END - s) AS content FROM walk
  UNION ALL
  SELECT doc_id, pos, pos + n, crumbs, text FROM z WHERE (n <= 1000 OR contains(text, '```')) AND regexp_matches(text, '\S'))
SELECT doc_id, (row_number() OVER w - 1)::BIGINT AS chunk_index, start::BIGINT AS start, "end"::BIGINT AS "end", crumbs AS cut_type, lead(start) OVER w IS NULL AS is_last, md5(content) AS content_md5
FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY start)""")
def markdown_chunks(spark, sf_dir):
    out = chunking.chunk(table(spark, sf_dir, "documents"), splitter=chunking.MarkdownSplitter())
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "start", "end")], "cut_type", "is_last", F.md5("content").alias("content_md5"))


_CONTEXT = "concat_ws(chr(10), CASE WHEN lang IS NOT NULL THEN 'Категория: ' || lang END, CASE WHEN source <> '' THEN 'Заголовок: ' || source END)"


@query(f"SELECT doc_id, {_CONTEXT} AS context, md5({_CONTEXT} || chr(10) || chr(10) || text) AS vector_text_md5 FROM documents")
def context_text(spark, sf_dir):
    ctx = tx.context_text(F.col("lang"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", ctx.alias("context"), F.md5(tx.vector_text(ctx, F.col("text"))).alias("vector_text_md5"))


# vectors

Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
RAW = f"(1 - list_cosine_similarity(embedding::DOUBLE[], {Q}))"
D = f"round({RAW}, 6)"


def the_query(spark, sf_dir) -> list[float]:
    """The query's vector: one row, a parameter."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def chunk_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % PARENTS).alias("doc_id"), "embedding")


@query(f"""
SELECT vec_id, {D} AS cosine,
  round(list_distance(embedding::DOUBLE[], {Q}), 6) AS l2,
  round(list_sum(list_transform(list_zip(embedding::DOUBLE[], {Q}), lambda p: abs(p[1] - p[2]))), 6) AS l1,
  round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::BIGINT AS dims
FROM embeddings""")
def vec_distances(spark, sf_dir):
    q = vx.literal(the_query(spark, sf_dir))
    r = lambda c: F.round(c, 6)
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r(vx.cosine_distance(e, q)).alias("cosine"), r(vx.l2_distance(e, q)).alias("l2"), r(vx.l1_distance(e, q)).alias("l1"), r(vx.norm(e)).alias("norm"), vx.length(e).cast("long").alias("dims"))


@query("""
WITH v AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, (i - 1)::BIGINT AS i, round(CASE WHEN n = 0 THEN x ELSE x / n END, 6) AS x FROM v""")
def vec_normalize(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vx.normalize("embedding")).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id, 4 * len(embedding)::BIGINT AS n_bytes, true AS same FROM embeddings")
def vec_blob_roundtrip(spark, sf_dir):
    blob = table(spark, sf_dir, "embeddings").withColumn("blob", vx.to_blob("embedding"))
    return blob.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), (vx.from_blob("blob") == F.col("embedding")).alias("same"))


@query(f"SELECT vec_id, {D} AS distance FROM embeddings ORDER BY {RAW}, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(rows, the_query(spark, sf_dir), 10, "vec_id")


@query("""
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""")
def vector_all_nearest(spark, sf_dir):
    """The ten nearest other vectors of every vector."""
    rows = table(spark, sf_dir, "embeddings")
    out = search.nearest_many(rows.withColumn("query_id", F.col("vec_id")), rows, 10, id_col="vec_id", others=True)
    return out.withColumns({"distance": F.round("distance", 6), "rank": F.col("rank").cast("long")})


@query(f"""
SELECT vec_id, {D} AS distance, row_number() OVER (ORDER BY {RAW}, vec_id) AS rank FROM embeddings WHERE label = 3 ORDER BY {RAW}, vec_id LIMIT 10""")
def vector_rows_facet(spark, sf_dir):
    """Whole documents with a vector each, filtered before they are ranked."""
    out = search.row_search(table(spark, sf_dir, "embeddings"), the_query(spark, sf_dir), facets={"label": 3}, id_col="vec_id")
    return out.withColumn("rank", F.col("rank").cast("long"))


def _vector_oracle(agg: str = "min", k: int | None = 100, pre: str = "", post: str = "", limit: int = 10) -> str:
    top = f"ORDER BY distance, chunk_id LIMIT {k}" if k else ""
    return f"""
WITH c AS (SELECT vec_id AS chunk_id, vec_id % {PARENTS} AS doc_id, {RAW} AS distance FROM embeddings),
h AS (SELECT c.* FROM c JOIN documents d USING (doc_id) {pre} {top}),
g AS (SELECT h.doc_id, {agg}(distance) AS distance, arg_min(chunk_id, (distance, chunk_id)) AS best_chunk FROM h JOIN documents d USING (doc_id) {post} GROUP BY h.doc_id)
SELECT doc_id, round(distance, 6) AS distance, best_chunk, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM g ORDER BY g.distance, doc_id LIMIT {limit}"""


def _vector(spark, sf_dir, **options):
    out = search.vector_search(table(spark, sf_dir, "documents"), chunk_vectors(spark, sf_dir), the_query(spark, sf_dir), **options)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(_vector_oracle())
def vector_parent_min(spark, sf_dir):
    return _vector(spark, sf_dir)


@query(_vector_oracle("avg"))
def vector_parent_avg(spark, sf_dir):
    return _vector(spark, sf_dir, agg="avg")


@query(_vector_oracle("max"))
def vector_parent_max(spark, sf_dir):
    return _vector(spark, sf_dir, agg="max")


@query(_vector_oracle(post="WHERE lang = 'fr'"))
def vector_facet_post(spark, sf_dir):
    return _vector(spark, sf_dir, facets={"lang": "fr"})


@query(_vector_oracle(pre="WHERE lang = 'fr'"))
def vector_facet_pre(spark, sf_dir):
    return _vector(spark, sf_dir, facets={"lang": "fr"}, facet_mode="pre")


@query(_vector_oracle(k=None))
def vector_exact(spark, sf_dir):
    return _vector(spark, sf_dir, exact=True)


# full text

_FOLD = f"translate(lower(%s), '{tx.FOLD_FROM}', '{tx.FOLD_TO}')"
_TOKENS = "regexp_extract_all(" + _FOLD + r", '[\p{L}\p{N}\p{Co}]+')"
TEXT, SOURCE = _TOKENS % "text", _TOKENS % "source"
TERMS = f"""
u AS (SELECT doc_id, 'text' AS field, {TEXT} AS terms FROM documents UNION ALL SELECT doc_id, 'source', {SOURCE} FROM documents),
t AS (SELECT doc_id, field, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM u),
l AS (SELECT doc_id, sum(len(terms))::BIGINT AS doc_len FROM u GROUP BY doc_id)
"""


FIELDS = {"source": None, "text": None}
_BUILT: dict[tuple[str, str], str] = {}


def build_index(spark, sf_dir) -> fulltext.Index:
    return fulltext.build(table(spark, sf_dir, "documents"), FIELDS)


def index_of(spark, sf_dir) -> fulltext.Index:
    """The index on disk, which the first query over these tables writes; later ones read their terms' part of it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        path = scratch(spark, "index")
        build_index(spark, sf_dir).write(path)
        _BUILT[key] = path
    return fulltext.Index.read(spark, _BUILT[key], tuple(FIELDS))


def _fts_oracle(leaves: list[str], holds: str, counted: list[int] | None = None, facet: str = "true", limit: int = 10) -> str:
    """leaves: conditions on t, or whole queries of (doc_id, tf); holds: a condition on tf0, tf1, ..."""
    leaf = [x if x.startswith("SELECT") else f"SELECT doc_id, count(*) AS tf FROM t WHERE {x} GROUP BY doc_id" for x in leaves]
    n = range(len(leaf))
    counted = list(n) if counted is None else counted
    idf = [f"greatest((SELECT CASE WHEN x > 0 THEN x ELSE 1e-6 END FROM (SELECT ln(((SELECT count(*) FROM l) - count(*) + 0.5) / (count(*) + 0.5)) AS x FROM leaf{i})), 1e-6)" for i in n]
    score = " - ".join(["0", *[f"{idf[i]} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * doc_len / (SELECT avg(doc_len) FROM l)))" for i in counted]])
    return f"""
{TERMS}, {", ".join(f"leaf{i} AS ({x})" for i, x in enumerate(leaf))},
m AS (SELECT l.doc_id, doc_len, {", ".join(f"coalesce(leaf{i}.tf, 0) AS tf{i}" for i in n)} FROM l {" ".join(f"LEFT JOIN leaf{i} USING (doc_id)" for i in n)}),
s AS (SELECT doc_id, {score} AS raw FROM m JOIN documents d USING (doc_id) WHERE ({holds}) AND {facet}),
fts AS (SELECT doc_id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw, doc_id) AS rank FROM s ORDER BY raw, doc_id LIMIT {limit})
"""


def _fts(spark, sf_dir, text: str, limit: int = 10, facets: dict | None = None, **options):
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where(search.facet_filter(docs, facets or {}))  # index rows without a document are never shown
    return fulltext.search(index_of(spark, sf_dir), text, limit, allowed, **options).withColumn("rank", F.col("rank").cast("long"))


def _register_fts(name: str, text: str, leaves: list[str], holds: str, counted: list[int] | None = None, facet: str = "true", facets: dict | None = None, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: _fts(spark, sf_dir, text, 50, facets, **options)
    ORACLES[name] = f"WITH {_fts_oracle(leaves, holds, counted, facet, 50)} SELECT * FROM fts"


_PHRASE = "SELECT a.doc_id, count(*) AS tf FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = '%s' AND b.term = '%s' GROUP BY a.doc_id"
_NEAR = "SELECT doc_id, count(*) AS tf FROM t a WHERE term = '%s' AND EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.field = a.field AND b.term = '%s' AND abs(a.pos - b.pos) - 1 <= 2) GROUP BY doc_id"
_register_fts("fts_term", "une", ["term = 'une'"], "tf0 > 0")
_register_fts("fts_and", "und AND die", ["term = 'und'", "term = 'die'"], "tf0 > 0 AND tf1 > 0")
_register_fts("fts_implicit_and", "los del", ["term = 'los'", "term = 'del'"], "tf0 > 0 AND tf1 > 0")
_register_fts("fts_or", "los OR une", ["term = 'los'", "term = 'une'"], "tf0 > 0 OR tf1 > 0")
_register_fts("fts_not", "the NOT ours", ["term = 'the'", "term = 'ours'"], "tf0 > 0 AND NOT tf1 > 0", [0])
_register_fts("fts_prefix", "licen*", ["term LIKE 'licen%'"], "tf0 > 0")
_register_fts("fts_phrase", '"of the"', [_PHRASE % ("of", "the")], "tf0 > 0")
_register_fts("fts_column", "source:src3 AND text:the", ["field = 'source' AND term = 'src3'", "field = 'text' AND term = 'the'"], "tf0 > 0 AND tf1 > 0")
_register_fts("fts_column_set", "{source text}:la OR {source}:src3", ["term = 'la'", "field = 'source' AND term = 'src3'"], "tf0 > 0 OR tf1 > 0")
_register_fts("fts_column_except", "-source:the", ["field <> 'source' AND term = 'the'"], "tf0 > 0")
_register_fts("fts_plus", "of + the", [_PHRASE % ("of", "the")], "tf0 > 0")
_register_fts("fts_initial", "text:^the", ["field = 'text' AND term = 'the' AND pos = 0"], "tf0 > 0")
_register_fts("fts_near", "NEAR(la de, 2)", [_NEAR % ("la", "de"), _NEAR % ("de", "la")], "tf0 > 0 AND tf1 > 0")
_register_fts("fts_nested", "(une OR die) AND NOT_A_TERM OR los NOT que", ["term = 'une'", "term = 'die'", _PHRASE % ("not", "a"), "term = 'los'", "term = 'que'"], "((tf0 > 0 OR tf1 > 0) AND tf2 > 0) OR (tf3 > 0 AND NOT tf4 > 0)", [0, 1, 2, 3])
_register_fts("fts_facet", "the", ["term = 'the'"], "tf0 > 0", facet="lang = 'en' AND source = 'src2'", facets={"lang": "en", "source": "src2"})
_register_fts("fts_plain", "wer, der?", ["term = 'wer'", "term = 'der'"], "tf0 > 0 OR tf1 > 0", parse_mode="plain_or")


@query(f"WITH {TERMS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term")
def fts_df(spark, sf_dir):
    return fulltext.document_frequency(index_of(spark, sf_dir))


@query(f"WITH {TERMS} SELECT doc_id, doc_len FROM l")
def fts_doc_stats(spark, sf_dir):
    return index_of(spark, sf_dir).stats.withColumn("doc_len", F.col("doc_len").cast("long"))


@query(f"WITH {TERMS} SELECT term, doc_id, field, count(*) AS tf FROM t WHERE doc_id >= 100 AND doc_id % 7 <> 3 GROUP BY ALL")
def fts_index_after_changes(spark, sf_dir):
    """The index after some documents went: their rows go, no others change."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("doc_id < 100 OR doc_id % 7 = 3").select("doc_id")
    out = index_of(spark, sf_dir).replaced(None, gone).postings
    return out.select("term", "doc_id", "field", F.col("tf").cast("long").alias("tf"))


_CHANGED = """
SELECT doc_id, source AS title, CASE WHEN doc_id % 10 = 0 THEN 'a changed note: ' || lang ELSE text END AS content FROM documents WHERE doc_id % 7 <> 3
UNION ALL SELECT doc_id + 1000000000, source, 'an added note ' || lang || text FROM documents WHERE doc_id % 50 = 1"""


@query(f"""
WITH n AS ({_CHANGED}), u AS (SELECT doc_id, 'title' AS field, {_TOKENS % "title"} AS terms FROM n UNION ALL SELECT doc_id, 'content', {_TOKENS % "content"} FROM n),
t AS (SELECT doc_id, field, unnest(terms) AS term FROM u)
SELECT term, doc_id, field, count(*) AS tf FROM t GROUP BY ALL""")
def store_index_after_changes(spark, sf_dir):
    """The index that a store keeps, after notes were changed, added and removed in three commits."""
    docs = table(spark, sf_dir, "documents")
    into = store.Store(spark, scratch(spark, "store"), index=("title", "content"))
    into.create()
    notes = sample_tables(spark, sf_dir)["notes"]
    into.save({"notes": notes})
    into.put(docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("a changed note: "), "lang").alias("content")), chunking.WindowSplitter())
    added = docs.where("doc_id % 50 = 1").select((F.col("doc_id") + 1000000000).alias("id"), F.col("source").alias("title"), F.concat(F.lit("an added note "), "lang", "text").alias("content"))
    into.put(added, chunking.WindowSplitter())
    into.remove(notes.where("id % 7 = 3").select("id"))
    return into.fulltext().postings.select("term", "doc_id", "field", F.col("tf").cast("long").alias("tf"))


# fusion

_FUSED = "SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(CASE WHEN list = 0 THEN rank END) AS rank_0, min(CASE WHEN list = 1 THEN rank END) AS rank_1 FROM both_lists GROUP BY doc_id"


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, 0 AS list FROM documents ORDER BY rank LIMIT 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank, 1 AS list FROM documents ORDER BY rank LIMIT 100),
both_lists AS (SELECT * FROM a UNION ALL SELECT * FROM b) {_FUSED}""")
def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5(F.col("doc_id").cast("string")).alias("h"))
    a = fusion.ranked(docs, F.desc("n_chars"), F.asc("doc_id"), most=100)
    b = fusion.ranked(docs, F.asc("h"), F.asc("doc_id"), most=100)
    return _fused(fusion.reciprocal_rank([a, b]))


def _fused(df):
    return df.select("doc_id", F.round("score", 12).alias("score"), *[F.col(c).cast("long").alias(c) for c in df.columns if c.startswith("rank")])


def _hybrid_oracle(k: int | None = 100, pre: str = "", post: str = "", facet: str = "true") -> str:
    top = f"ORDER BY distance, chunk_id LIMIT {k}" if k else ""
    return f"""
WITH {_fts_oracle(["term = 'les'", "term = 'und'"], "tf0 > 0 OR tf1 > 0", None, facet, 100)},
c AS (SELECT vec_id AS chunk_id, vec_id % {PARENTS} AS doc_id, {RAW} AS distance FROM embeddings),
h AS (SELECT c.* FROM c JOIN documents d USING (doc_id) {pre} {top}),
g AS (SELECT h.doc_id, min(distance) AS distance FROM h JOIN documents d USING (doc_id) {post} GROUP BY h.doc_id),
v AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS rank FROM g ORDER BY distance, doc_id LIMIT 100),
both_lists AS (SELECT doc_id, rank, 0 AS list FROM v UNION ALL SELECT doc_id, rank, 1 FROM fts),
f AS ({_FUSED})
SELECT *, row_number() OVER (ORDER BY score DESC, rank_0 NULLS LAST, doc_id) AS rank FROM f ORDER BY score DESC, rank_0 NULLS LAST, doc_id LIMIT 10"""


def _hybrid(spark, sf_dir, **options):
    return _fused(search.hybrid_search(table(spark, sf_dir, "documents"), chunk_vectors(spark, sf_dir), index_of(spark, sf_dir), the_query(spark, sf_dir), "les OR und", **options))


@query(_hybrid_oracle())
def hybrid_chunks(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(_hybrid_oracle(k=None))
def hybrid_whole_doc(spark, sf_dir):
    return _hybrid(spark, sf_dir, exact=True)


@query(_hybrid_oracle(post="WHERE lang = 'fr'", facet="lang = 'fr'"))
def hybrid_facet(spark, sf_dir):
    return _hybrid(spark, sf_dir, facets={"lang": "fr"})


@query(_hybrid_oracle(k=None, pre="WHERE lang = 'fr'", facet="lang = 'fr'"))
def hybrid_facet_pre(spark, sf_dir):
    return _hybrid(spark, sf_dir, exact=True, facets={"lang": "fr"}, facet_mode="pre")


@query(f"WITH top AS ({_hybrid_oracle()}) SELECT *, CASE WHEN rank_1 IS NULL THEN 'VECTOR' WHEN rank_0 IS NULL THEN 'FTS' ELSE 'HYBRID' END AS match_type FROM top")
def declared_index(spark, sf_dir):
    """Hybrid search through a declared index whose query vectors are kept; what found each row."""
    vector = np.array(the_query(spark, sf_dir), np.float32)

    class Given:
        dimension = len(vector)

        def embed(self, texts, task="document"):
            return np.stack([vector] * len(texts))

    index = search.SearchIndex(table(spark, sf_dir, "documents"), chunk_vectors(spark, sf_dir), index_of(spark, sf_dir), QueryCache(Given()))
    out = index.hybrid("les, und?", parse_mode="plain_or")
    return _fused(out).join(out.select("doc_id", "match_type"), "doc_id")


@query(f"WITH top AS ({_hybrid_oracle()}) SELECT top.rank, doc_id, lang, source, md5(text) AS text_md5 FROM top JOIN documents USING (doc_id)")
def hydrated_results(spark, sf_dir):
    top = _hybrid(spark, sf_dir).select("doc_id", "rank")
    return search.hydrate(top, table(spark, sf_dir, "documents")).select("rank", "doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def facet_counts(spark, sf_dir):
    return search.facet_counts(table(spark, sf_dir, "documents"), "lang")


# embedding and ingest

_SUMS = """
SELECT {key}, (('0x' || substr(md5(term), 1, 8))::UBIGINT % 64)::BIGINT AS bucket, sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x
FROM {of} GROUP BY ALL"""


@query(f"""
WITH w AS (SELECT doc_id, unnest({TEXT}) AS term FROM documents),
b AS ({_SUMS.format(key="doc_id", of="w")}), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, bucket, round((x / norm)::FLOAT::DOUBLE, 6) AS x FROM b JOIN n USING (doc_id) WHERE norm > 0 AND x <> 0""")
def hash_embed_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", embed_column(HashingEmbedder(), F.col("text")).alias("v"))
    return docs.select("doc_id", F.posexplode("v").alias("bucket", "x")).where("x <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query(ORACLES["hash_embed_docs"])
def embed_sql(spark, sf_dir):
    """The same vectors by a table function in a statement."""
    from tidewater.functions.sql import register

    register(spark)
    statement = """
    SELECT doc_id, CAST(bucket AS LONG) AS bucket, round(CAST(x AS DOUBLE), 6) AS x
    FROM embed_rows(TABLE(SELECT doc_id, text FROM {documents}), 'text'), LATERAL posexplode(embedding) AS (bucket, x) WHERE x <> 0"""
    return spark.sql(statement, documents=table(spark, sf_dir, "documents"))


QUESTION = "the licence of the people and the king"


@query(f"""
WITH {CHUNKS},
w AS (SELECT doc_id, chunk_index, unnest({_TOKENS % f"({_CONTEXT} || chr(10) || chr(10) || content)"}) AS term FROM cut JOIN documents USING (doc_id)),
b AS ({_SUMS.format(key="doc_id, chunk_index", of="w")}), n AS (SELECT doc_id, chunk_index, sqrt(sum(x * x)) AS norm FROM b GROUP BY ALL),
qw AS (SELECT 0 AS q, unnest({_TOKENS % f"'{QUESTION}'"}) AS term), qb AS ({_SUMS.format(key="q", of="qw")}),
d AS (SELECT n.doc_id, n.chunk_index, 1 - sum((b.x / norm)::FLOAT::DOUBLE * (qb.x / (SELECT sqrt(sum(x * x)) FROM qb))::FLOAT::DOUBLE) AS distance FROM n JOIN b USING (doc_id, chunk_index) JOIN qb USING (bucket) GROUP BY ALL),
k AS (SELECT doc_id, chunk_index, round(distance, 5) AS distance FROM d),
g AS (SELECT doc_id, min(distance) AS distance FROM k GROUP BY doc_id)
SELECT doc_id, distance FROM g ORDER BY distance, doc_id LIMIT 10""")
def ingest_then_search(spark, sf_dir):
    """Documents to chunks to vectors of chunks in their context, then the nearest documents to a question."""
    docs = table(spark, sf_dir, "documents")
    embedder = HashingEmbedder()
    named = docs.select("doc_id", tx.context_text(F.col("lang"), F.col("source")).alias("context"))
    rows = chunking.chunk(docs).join(named, "doc_id").select("doc_id", F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), embed_column(embedder, tx.vector_text(F.col("context"), F.col("content"))).alias("embedding"))
    hits = search.nearest(rows, embed_query(embedder, QUESTION).tolist(), None, digits=5)
    found = hits.groupBy("doc_id").agg(F.min("distance").alias("distance"))
    return found.orderBy("distance", "doc_id").limit(10)


# maintenance


def sample_tables(spark, sf_dir) -> dict[str, DataFrame]:
    """The store's tables made of the test tables."""
    docs = table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    lang = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 3).otherwise(4).cast("long")
    return {
        "categories": spark.createDataFrame([(1, "en"), (2, "de"), (3, "fr"), (4, "es")], "id long, name string").withColumn("created_at", at),
        "tags": docs.select(F.substring("source", 4, 9).cast("long").alias("id"), F.col("source").alias("name")).distinct().withColumn("created_at", at),
        "notes": docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), lang.alias("category_id"), at.alias("created_at"), at.alias("updated_at")),
        "note_tags": docs.select(F.col("doc_id").alias("note_id"), F.substring("source", 4, 9).cast("long").alias("tag_id"), at.alias("created_at")),
        "note_chunks": chunking.chunk(docs).select(F.xxhash64("doc_id", "chunk_index").alias("id"), F.col("doc_id").alias("note_id"), "chunk_index", "content", at.alias("created_at"), F.lit(None).cast("array<float>").alias("embedding")),
    }


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS changed, round(list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END, 4) AS total FROM embeddings UNION ALL SELECT -1 - vec_id, 1, round(list_sum(embedding::DOUBLE[]) * 2, 4) FROM embeddings WHERE vec_id % 5 = 0")
def upsert_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(0).cast("long").alias("changed"))
    twice = rows.where("vec_id % 5 = 0").withColumns({"embedding": F.transform("embedding", lambda x: x * 2), "changed": F.lit(1).cast("long")})
    out = store.upsert(rows, twice.unionByName(twice.withColumn("vec_id", -1 - F.col("vec_id"))), ["vec_id"])
    return out.select("vec_id", "changed", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {CHUNKS} SELECT doc_id AS note_id, chunk_index::BIGINT AS chunk_index, md5(content) AS content_md5 FROM cut WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 0, md5('short') FROM documents WHERE doc_id % 10 = 0")
def replace_chunks(spark, sf_dir):
    tables = sample_tables(spark, sf_dir)
    changed = tables["notes"].where("id % 10 = 0").select("id", F.lit("short").alias("content"))
    out = store.save_notes(tables, changed, chunking.WindowSplitter())
    return out["note_chunks"].select("note_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


_LEFT = "(SELECT * FROM documents WHERE doc_id % 4 <> 1)"


@query(f"""
WITH {CHUNKS} SELECT 'notes' AS name, count(*) AS n FROM {_LEFT} UNION ALL SELECT 'note_chunks', count(*) FROM cut WHERE doc_id % 4 <> 1
UNION ALL SELECT 'note_tags', count(*) FROM {_LEFT} UNION ALL SELECT 'tags', count(DISTINCT source) FROM documents UNION ALL SELECT 'categories', 4""")
def delete_cascade(spark, sf_dir):
    tables = sample_tables(spark, sf_dir)
    return _sizes(store.delete_cascade(tables, "notes", tables["notes"].where("id % 4 = 1")))


@query(f"""
WITH {CHUNKS} SELECT 'notes' AS name, count(*) AS n FROM documents WHERE lang <> 'en' UNION ALL SELECT 'note_chunks', count(*) FROM cut JOIN documents USING (doc_id) WHERE lang <> 'en'
UNION ALL SELECT 'note_tags', count(*) FROM documents WHERE lang <> 'en' UNION ALL SELECT 'tags', count(DISTINCT source) FROM documents UNION ALL SELECT 'categories', 3""")
def delete_category(spark, sf_dir):
    tables = sample_tables(spark, sf_dir)
    return _sizes(store.delete_cascade(tables, "categories", tables["categories"].where("name = 'en'")))


def _sizes(tables: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()])


@query("SELECT doc_id AS id, doc_id % 10 = 0 AS moved FROM documents")
def touched_notes(spark, sf_dir):
    """Saving a note moves its updated_at, and no other's."""
    tables = sample_tables(spark, sf_dir)
    out = store.save_notes(tables, tables["notes"].where("id % 10 = 0").select("id", "title"), chunking.WindowSplitter())
    return out["notes"].select("id", (F.col("updated_at") > F.col("created_at")).alias("moved"))


@query("SELECT count(*) FILTER (doc_id % 3 = 1) AS removed, 0::BIGINT AS again, count(*) FILTER (doc_id % 3 <> 1) AS n_left FROM documents")
def removed_notes(spark, sf_dir):
    """How many notes removing some of them says it has removed, at first and again."""
    into, notes = store.Store(spark, scratch(spark, "store")), sample_tables(spark, sf_dir)["notes"]
    into.create()
    into.save({"notes": notes})
    gone = notes.where("id % 3 = 1").select("id")
    removed, again = into.remove(gone), into.remove(gone)
    return into.table("notes").agg(F.lit(removed).cast("long").alias("removed"), F.lit(again).cast("long").alias("again"), F.count("*").alias("n_left"))


@query(f"""
WITH {CHUNKS}, n AS (
  SELECT 'notes' AS name, count(*) AS n FROM documents UNION ALL SELECT 'note_chunks', count(*) FROM cut UNION ALL SELECT 'note_tags', count(*) FROM documents
  UNION ALL SELECT 'tags', count(DISTINCT source) FROM documents UNION ALL SELECT 'categories', 4)
SELECT *, true AS loaded_once, true AS dropped FROM n""")
def seeded_store(spark, sf_dir):
    """Rows of a store that was seeded twice, loaded once and dropped."""
    into, loads = store.Store(spark, scratch(spark, "store")), []
    into.create()

    def load():
        loads.append(1)
        return sample_tables(spark, sf_dir)

    into.seed(load)
    rows = into.seed(load)
    into.drop()
    return spark.createDataFrame([(k, n, len(loads) == 1, into.state().n == 0) for k, n in rows.items()], "name string, n long, loaded_once boolean, dropped boolean")


@query(r"SELECT doc_id, NOT regexp_matches(CASE WHEN doc_id % 5 = 0 THEN repeat(' ', doc_id % 3) ELSE text END, '\S') AS blank FROM documents")
def blank_texts(spark, sf_dir):
    """Blank texts have no vector."""
    text = F.expr("CASE WHEN doc_id % 5 = 0 THEN repeat(' ', CAST(doc_id % 3 AS INT)) ELSE text END")
    return table(spark, sf_dir, "documents").select("doc_id", try_embed_column(HashingEmbedder(), text).isNull().alias("blank"))


@query("SELECT doc_id, md5(concat_ws(chr(10), 'Document: ' || source, 'Path: ' || lang, 'Context: Code Snippet (' || lang || ')') || chr(10) || '---' || chr(10) || text) AS text_md5 FROM documents WHERE source <> '' AND lang <> ''")
def breadcrumbs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source <> '' AND lang <> ''")
    return docs.select("doc_id", F.md5(tx.breadcrumb_text(F.col("source"), F.col("lang"), F.col("text"), F.col("lang"))).alias("text_md5"))


@query("SELECT doc_id, translate(substr(text, 1, 30), chr(10), ' ') || '...' AS p30, translate(substr(text, 1, 50), chr(10), ' ') || '...' AS p50 FROM documents")
def note_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview("text", 30).alias("p30"), tx.preview("text", 50).alias("p50"))


@query("SELECT doc_id AS id, source AS tag, lang AS category FROM documents")
def note_tags_bridge(spark, sf_dir):
    t = sample_tables(spark, sf_dir)
    tags = t["tags"].select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    categories = t["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return t["notes"].join(t["note_tags"].join(tags, "tag_id"), t["notes"]["id"] == F.col("note_id")).join(categories, "category_id", "left").select("id", "tag", "category")


@query("SELECT text AS content, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return store.violations(sample_tables(spark, sf_dir)["notes"], ["content"])


@query("SELECT min(doc_id) AS id FROM documents WHERE doc_id >= 300 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 300) GROUP BY text")
def content_hash_dedup(spark, sf_dir):
    notes = sample_tables(spark, sf_dir)["notes"]
    return store.new_content(notes.where("id >= 300"), notes.where("id < 300")).select("id")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 30)::BIGINT AS job FROM documents")
def batch_jobs(spark, sf_dir):
    from tidewater.streaming.ingest import batch_jobs as jobs

    return jobs(table(spark, sf_dir, "documents").select("doc_id"), 30, "doc_id")


@query("SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE source = 'src3' AND n_chars > 900 GROUP BY lang")
def raw_sql(spark, sf_dir):
    """A statement with bound parameters over tables by name."""
    tables = {"documents": table(spark, sf_dir, "documents")}
    return store.sql(tables, "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents WHERE source = ? AND n_chars > ? GROUP BY lang", ["src3", 900])


@query("SELECT doc_id, md5(lang || chr(10) || source || chr(10) || text) AS text_md5 FROM documents WHERE text <> ''")
def search_text_template(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", F.md5(tx.search_text("lang", "source", "text")).alias("text_md5"))


@query("""
WITH j AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS job, trim(text) = '' AS blank FROM documents)
SELECT job, CASE WHEN bool_or(blank) THEN 'FAILED' ELSE 'READY' END AS state, count(*) AS n FROM j GROUP BY job""")
def deferred_queue(spark, sf_dir):
    """All documents wait as chunks without vectors, are sent in jobs of 100 and embedded."""
    from tidewater.streaming.ingest import Queue

    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))
    return Queue(chunks).flush(100).sync(HashingEmbedder()).jobs()


@query("SELECT lang, count(*) AS n_documents, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY lang")
def corpus_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@query(f"WITH {CHUNKS} SELECT doc_id AS note_id, count(*) AS n_chunks, count(*) AS n_vectors FROM cut WHERE trim(text) <> '' GROUP BY doc_id")
def ingest_stream(spark, sf_dir):
    """Documents as a stream into a store, then what the store holds."""
    from tidewater.operators.store import Store
    from tidewater.streaming.ingest import ingest

    root = scratch(spark, "store")
    into = Store(spark, root)
    into.create()
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    notes = stream.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), F.lit(None).cast("long").alias("category_id"), at.alias("updated_at"))
    ingest(notes, into, chunking.WindowSplitter(), HashingEmbedder(), f"{root}/log").awaitTermination()
    return into.table("note_chunks").groupBy("note_id").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_vectors"))

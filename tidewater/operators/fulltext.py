"""An inverted index as two tables, and BM25 search over it.

postings: (term, doc_id, field, tf, positions), sorted by term within its files, so that `term IN (...)` prunes row
groups; stats: (doc_id, doc_len). The index is a pure function of the documents, so it is never stale: after a change
the affected documents' rows are replaced.

Tokens are grouped where their rows are: a worker cuts some megabytes of texts at a time and gathers their tokens by term,
column by column in Arrow and numpy, into blocks of up to BLOCK postings of one term and field. Blocks are written once,
so no token is shuffled, and whatever reads postings or lengths cuts no text again. It is blocks that are sampled, dealt
and sorted (by term and first document), a fraction of the postings in number; they are taken apart where they arrive.
Letters lose their diacritics after the cut, which moves no edge: letters become letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidewater.functions.text import TOKEN, folded
from tidewater.plans.ftsquery import Node, Phrase, Query, parse, plain
from tidewater.sources.shared import written

#: Fixed values of the ranking formula.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Postings of a block, and bytes of text that a worker groups at once (a longer text is grouped by itself).
BLOCK, PART = 64, 1 << 24


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    stats: DataFrame
    fields: tuple[str, ...]
    blocks: DataFrame | None = None

    def dealt(self) -> DataFrame:
        """The postings as files hold them."""
        if self.blocks is None:
            return dealt(self.postings)
        first = F.col("ids")[0]
        return _apart(self.blocks.repartitionByRange("term", first).sortWithinPartitions("term", first))

    def write(self, path: str) -> None:
        self.dealt().write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark, path: str, fields: tuple[str, ...]) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), fields)

    def replaced(self, docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> Index:
        """The index after `gone` (doc_id) went and `docs` came or changed."""
        new = build(docs, dict.fromkeys(self.fields), id_col) if docs is not None else None
        stale = gone.select("doc_id") if new is None else gone.select("doc_id").union(new.stats.select("doc_id"))
        keep = lambda x: x.join(stale.distinct(), "doc_id", "left_anti")
        if new is None:
            return Index(keep(self.postings).select(*self.postings.columns), keep(self.stats), self.fields)
        return Index(keep(self.postings).unionByName(new.postings), keep(self.stats).unionByName(new.stats), self.fields)


def dealt(postings: DataFrame) -> DataFrame:
    """Postings as files hold them: a query's terms are in few row groups, a stop word's are spread by document."""
    return postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def _apart(blocks: DataFrame) -> DataFrame:
    """Blocks as postings: the positions of the k-th document are those from at[k] to at[k + 1]."""
    each = blocks.select("term", "field", "at", "positions", F.posexplode("ids").alias("k", "doc_id"))
    tf = F.col("at")[F.col("k") + 1] - F.col("at")[F.col("k")]
    return each.select("term", "doc_id", "field", tf.alias("tf"), F.slice("positions", F.col("at")[F.col("k")] + 1, tf).alias("positions"))


def _terms(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms of unfolded words, in order, and which of them each word is."""
    coded = words.dictionary_encode()
    low = coded.dictionary
    other = pc.invert(pc.string_is_ascii(low))
    if pc.any(other).as_py():
        low = pc.replace_with_mask(low, other, pa.array([folded(t) for t in low.filter(other).to_pylist()], pa.string()))
    terms = low.dictionary_encode()
    order = pc.sort_indices(terms.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return terms.dictionary.take(order), rank[terms.indices.to_numpy()][coded.indices.to_numpy()]


def gathered(ids: pa.Array, texts: pa.Array, field: str) -> tuple[list[pa.Array], np.ndarray]:
    """The blocks of texts in lower case, by term, as columns (none if there are no tokens), and how many tokens each text has."""
    sizes = np.zeros(len(texts), np.int32)
    texts = pc.ascii_trim(pc.replace_substring_regex(texts, "[^" + TOKEN[1:], " "), " ")
    filled = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(filled):
        return [], sizes
    words = pc.split_pattern(texts.take(pa.array(filled)), " ")
    sizes[filled] = count = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    terms, code = _terms(words.flatten())
    # words are in the order of their rows; two stable passes by 16 bits put them in the order of their terms
    by = np.argsort(code.astype(np.uint16), kind="stable")
    by = by[np.argsort((code >> 16).astype(np.uint16)[by], kind="stable")]
    code, row = code[by], np.repeat(np.arange(len(filled), dtype=np.int32), count)[by]
    place = by - (np.cumsum(count) - count)[row]
    at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1]))))
    ends = np.append(at, len(code))
    code, row = code[at], row[at]
    new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    block = np.flatnonzero((np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))) % BLOCK == 0)
    edge = np.append(block, len(code))
    # each block has an edge more than documents
    inside = np.arange(len(code) + len(block)) - np.repeat(np.arange(len(block)), np.diff(edge) + 1)
    offsets = ends[inside] - np.repeat(at[block], np.diff(edge) + 1)
    listed = lambda offset, values: pa.ListArray.from_arrays(pa.array(offset, pa.int32()), values)
    return [
        terms.take(pa.array(code[block])),
        pa.array([field]).take(pa.array(np.zeros(len(block), np.int32))),
        listed(edge, ids.take(pa.array(filled[row]))),
        listed(edge + np.arange(len(edge)), pa.array(offsets, pa.int32())),
        listed(ends[edge], pa.array(place, pa.int32())),
        pa.nulls(len(block), pa.list_(pa.int32())),
    ], sizes


COLUMNS = ["term", "field", "ids", "at", "positions", "sizes"]


def _in_blocks(fields: tuple[str, ...]):
    """(doc_id, a text in lower case a field) to COLUMNS: blocks, and rows without a term that hold ids and sizes of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            held = np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in x.columns[1:]))
            start = 0
            while start < len(held):
                stop = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + PART, "right")))
                ids, *texts = x.slice(start, stop - start).columns
                total = np.zeros(len(ids), np.int32)
                for field, text in zip(fields, texts, strict=True):
                    made, sizes = gathered(ids, text, field)
                    total += sizes
                    if made:
                        yield pa.RecordBatch.from_arrays(made, COLUMNS)
                edge = pa.array([*range(0, len(ids), BLOCK), len(ids)], pa.int32())
                none, no_list = (pa.nulls(len(edge) - 1, t) for t in (pa.string(), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([none, none, pa.ListArray.from_arrays(edge, ids), no_list, no_list, pa.ListArray.from_arrays(edge, pa.array(total))], COLUMNS)
                start = stop

    return run


def build(docs: DataFrame, fields: dict[str, str | None], id_col: str = "doc_id") -> Index:
    """fields: name in queries -> column (None: the same name). Positions restart in each field. Rows that share an id
    are one document, with a row each in stats."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.lower(F.coalesce(F.col(column or name), F.lit(""))).alias(f"t{i}") for i, (name, column) in enumerate(fields.items())])
    ints = ArrayType(IntegerType())
    types = [StringType(), StringType(), ArrayType(rows.schema["doc_id"].dataType), ints, ints, ints]
    made = StructType([StructField(name, t) for name, t in zip(COLUMNS, types, strict=True)])
    held = written(rows.mapInArrow(_in_blocks(tuple(fields)), made), "index")
    blocks = held.where("term IS NOT NULL").drop("sizes")
    stats = held.where("term IS NULL").select("sizes", F.posexplode("ids").alias("k", "doc_id")).select("doc_id", F.col("sizes")[F.col("k")].alias("doc_len"))
    each = _apart(blocks)
    again = stats.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    if not again.isEmpty():
        several = F.col("doc_id").eqNullSafe(F.col("_id"))
        merged = each.join(again, several, "left_semi").groupBy("term", "doc_id", "field").agg(F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        each = each.join(again, several, "left_anti").unionByName(merged)
        blocks = None
    return Index(each, stats, tuple(fields), blocks)


def document_frequency(index: Index) -> DataFrame:
    """(term, df, occurrences)."""
    return index.postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("occurrences"))


def _is_term(term: str, prefix: bool) -> Column:
    return F.col("term").startswith(term) if prefix else F.col("term") == term


def _wanted(p: Phrase) -> Column:
    """Postings that a phrase reads."""
    some = reduce(lambda a, b: a | b, [_is_term(t, p.prefix and i == len(p.terms) - 1) for i, t in enumerate(p.terms)])
    return some if p.columns is None else some & F.col("field").isin(*p.columns)


def _minus(n: int):
    return lambda x: x - n


def _starts(p: Phrase) -> Column:
    """Sorted starts of a phrase in one field of one document, over that field's collected postings."""
    at = []
    for i, t in enumerate(p.terms):
        here = F.when(_is_term(t, p.prefix and i == len(p.terms) - 1), F.col("positions"))
        at.append(F.transform(F.flatten(F.collect_list(here)), _minus(i)))
    found = reduce(F.array_intersect, at) if len(at) > 1 else F.array_distinct(at[0])
    if p.initial:
        found = F.filter(found, lambda x: x == 0)
    return found if p.columns is None else F.when(F.col("field").isin(*p.columns), found).otherwise(F.array().cast("array<int>"))


def _alive(fields: DataFrame, query: Query) -> DataFrame:
    """(doc_id, i, start): the starts of phrase i that count. fields: doc_id, field and the sorted starts s0, s1, ...

    In a NEAR group some phrase starts last, at m, and every phrase has a start at m or before it that ends at most n
    tokens before m; starts that are part of such a match count. Starts are merged in their order: what stands last
    before m, and which m comes next, are running values of a window over one field of one document.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("s")) for i in range(len(query.phrases))]))
    starts = fields.select("doc_id", "field", each.alias("x")).select("doc_id", "field", F.col("x.i").alias("i"), F.explode("x.s").alias("start"))
    out = [starts.where(F.col("i").isin(*alone)).select("doc_id", "i", "start")] if (alone := [i for i, p in enumerate(query.phrases) if p.near is None]) else []
    for group, n in enumerate(query.near):
        members = [i for i, p in enumerate(query.phrases) if p.near == group]
        reach = {i: len(query.phrases[i].terms) + n for i in members}
        by = W.partitionBy("doc_id", "field").orderBy("start")
        so_far, from_here = by.rangeBetween(W.unboundedPreceding, 0), by.rangeBetween(0, W.unboundedFollowing)
        last = {j: F.max(F.when(F.col("i") == j, F.col("start"))).over(so_far) for j in members}
        whole = reduce(lambda a, b: a & b, [F.coalesce(F.col("start") - last[j] <= reach[j], F.lit(False)) for j in members])
        rows = starts.where(F.col("i").isin(*members)).withColumn("m", F.when(whole, F.col("start")))
        size = F.element_at(F.create_map(*[F.lit(x) for i in members for x in (i, reach[i])]), F.col("i"))
        rows = rows.withColumn("next", F.min("m").over(from_here)).where(F.col("next") - F.col("start") <= size)
        out.append(rows.select("doc_id", "i", "start"))
    return reduce(DataFrame.union, out)


def _holds(node: Node) -> Column:
    if node.kind == "leaf":
        return reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in node.leaves], F.lit(bool(node.leaves)))
    parts = [_holds(c) for c in node.children]
    if node.kind == "or":
        return reduce(lambda a, b: a | b, parts)
    if node.kind == "not":
        return reduce(lambda a, b: a & ~b, parts)
    return reduce(lambda a, b: a & b, parts)


def _scored(node: Node, out: set[int], live: bool = True) -> set[int]:
    """Phrases that count: what stands behind NOT doesn't."""
    if node.kind == "leaf":
        return set(node.leaves) if live else set()
    return set().union(*(_scored(c, out, live and (node.kind != "not" or i == 0)) for i, c in enumerate(node.children)))


def matches(index: Index, query: str | Query, parse_mode: str = "fts") -> tuple[DataFrame, Query]:
    """(doc_id, tf0, tf1, ...) of documents with any of the query's phrases: one aggregation by document."""
    if isinstance(query, str):
        query = parse(query, index.fields) if parse_mode == "fts" else plain(query, "or" if parse_mode == "plain_or" else "and")
    phrases = query.phrases
    n = len(phrases)
    if not n:
        return index.stats.select("doc_id").where("false"), query
    # term conditions reach the scan of the sorted postings
    rows = index.postings.where(reduce(lambda a, b: a | b, [_wanted(p) for p in phrases]))
    if all(len(p.terms) == 1 and not p.initial and p.near is None and not p.prefix for p in phrases):
        tf = [F.sum(F.when(_wanted(p), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, p in enumerate(phrases)]
        return rows.groupBy("doc_id").agg(*tf), query
    fields = rows.groupBy("doc_id", "field").agg(*[_starts(p).alias(f"s{i}") for i, p in enumerate(phrases)])
    if query.near:
        return _alive(fields, query).groupBy("doc_id").agg(*[F.count_if(F.col("i") == i).alias(f"tf{i}") for i in range(n)]), query
    return fields.groupBy("doc_id").agg(*[F.sum(F.size(f"s{i}")).alias(f"tf{i}") for i in range(n)]), query


def search(index: Index, query: str | Query, limit: int | None = 10, facets: DataFrame | None = None, parse_mode: str = "fts") -> DataFrame:
    """(doc_id, score, rank): BM25, negative, best first; ties by id. facets: ids that may be returned.

    Numbers of documents and lengths are of the whole corpus, whatever the facets. limit None: all, unranked.
    """
    from tidewater.operators.fusion import ranked

    hits, parsed = matches(index, query, parse_mode)
    n = len(parsed.phrases)
    counted = sorted(_scored(parsed.root, set()))
    corpus = index.stats.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg")).first()
    df = hits.agg(F.lit(0).alias("_"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"n{i}") for i in range(n)]).first()  # a row
    found = hits.where(_holds(parsed.root)).join(index.stats, "doc_id")
    if facets is not None:
        found = found.join(facets.select("doc_id"), "doc_id", "left_semi")
    score = F.lit(0.0)
    for i in counted:
        here = df[f"n{i}"] or 0
        idf = math.log((corpus["n"] - here + 0.5) / (here + 0.5))
        tf, size = F.col(f"tf{i}").cast("double"), F.col("doc_len") / F.lit(corpus["avg"] or 1.0)
        score = score - F.lit(idf if idf > 0 else IDF_FLOOR) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * size))
    found = found.select("doc_id", score.alias("score"))
    # ranked by the whole value, rounded to be read
    found = found if limit is None else ranked(found, F.asc("score"), F.asc("doc_id"), most=limit)
    return found.withColumn("score", F.round("score", 6))

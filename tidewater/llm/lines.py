"""Line dedup by distinct-site spread.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation. Lines whose
estimate lies near the threshold get an exact distinct count. A line on `min_sites` sites or more is boilerplate: its
first occurrence in the corpus stays, so that no content is lost from it altogether, and every other one is removed.

Lines are compared with runs of ASCII blanks made one space and outer blanks cut, by 128 bits of hash. Defined results:
wordless lines always stay; a null site counts as no site; a null text stays null and has no lines; the first
occurrence is the one with the smallest id (null ids first), then text hash, then line; rows alike in id and text are
treated alike; an empty table gives no rows. `drop_boilerplate` keeps further columns, whatever their names, as they are;
`cut_lines` takes none named `_id`, `_mark`, `_own` or `_removed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, Cuts, set_aside

MIN_SITES = 10
#: log2 of a sketch's registers: a relative standard error of 1.6 %.
LG_K = 12
#: An estimate this far from the threshold, relatively, is trusted: over six standard errors.
BAND = 0.1


def exploded(docs: DataFrame, site_col: str) -> DataFrame:
    """(doc_id, mark, pos, h1, h2, site): one row per line with a word."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col(site_col).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(f"[^{SPACE}]"))
    plain = F.trim(F.regexp_replace("line", f"[{SPACE}]+", " "))
    return lines.select("doc_id", "mark", "pos", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"), "site")


def boilerplate(rows: DataFrame, cuts: Cuts, min_sites: int) -> DataFrame:
    """(h1, h2, first): the lines to remove, and the occurrence that stays."""
    first = F.min(F.struct("doc_id", "mark", "pos")).alias("first")
    spread = rows.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"), first)
    # a line can't be on more sites than it has occurrences
    spread = cuts.write(spread.where(F.col("n") >= min_sites).drop("n"))
    slack = max(1.0, BAND * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= slack).select("h1", "h2", "first")
    exact = rows.join(near.drop("first"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites + slack).select("h1", "h2", "first")
    return cuts.write(sure.union(near.join(exact.select("h1", "h2"), ["h1", "h2"])))


def removals(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, mark, removed): positions of the removed lines of each text that has some."""
    cuts = Cuts(docs.sparkSession)
    rows = cuts.write(exploded(docs, site_col))
    gone = rows.drop("site").join(boilerplate(rows, cuts, min_sites), ["h1", "h2"]).where("struct(doc_id, mark, pos) <> first")
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("removed"))


def cut_lines(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, text, the site's column) with `text` less its boilerplate lines, and `_removed`, their number."""
    gone = removals(docs, site_col, min_sites).withColumnsRenamed({"doc_id": "_id", "mark": "_mark", "removed": "_removed"})
    rows = docs.withColumn("_own", F.xxhash64("text"))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_id"]) & (rows["_own"] == gone["_mark"]), "left").drop("_id", "_mark", "_own")

    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_removed", i))
    return rows.withColumns({"text": F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")), "_removed": F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed"))})


def drop_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with shortened texts; n_chars, where there is one, follows. Every row stays."""
    rows, back = set_aside(docs, "doc_id", "text", "n_chars", site_col)
    out = cut_lines(rows, site_col, min_sites)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM l),
b AS (
  SELECT x, min({'d': doc_id, 'p': pos}) AS first FROM k WHERE x <> '' GROUP BY x HAVING count(DISTINCT source) >= 10),
f AS (
  SELECT k.*, b.x IS NOT NULL AND {'d': doc_id, 'p': pos} <> b.first AS gone FROM k LEFT JOIN b ON k.x = b.x)
SELECT doc_id, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

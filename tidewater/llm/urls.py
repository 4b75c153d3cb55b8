"""URL filters: block lists over time.

Dated entries of lists ("add" or "remove" of a pattern from a day on) become validity intervals, and an as-of join
evaluates each capture against the entries active on the day it was fetched. All of it is DataFrame code: captures are
exploded to the patterns that could match them, joined by pattern and interval, and counted per capture.

Patterns: `d:example.org` matches the host and all below it; `p:example.org/a/b` matches this host's paths that start
with these segments. A URL's schemes, case of host, user, port, query and fragment don't matter. Defined results: null
and unparsable URLs match nothing; a null day has no active entries; of entries for one pattern and day "remove" wins;
captures alike in id, URL and day are treated alike, each row stays; empty lists block nothing; an empty table of
captures gives no rows; captures keep further columns, but none named `_id`, `_day`, `_own`, `_mark`, `_n`, `_l`,
`n_active`, `first_list` or `blocked`. Long URLs: only as many labels and segments are tried as the longest pattern has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    h = F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(h, ":[0-9]*$", ""), r"\.$", ""))


def segments_of(url: Column) -> Column:
    return F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to): days on which a pattern is listed; valid_to is exclusive, null: open.

    entries: list_name, pattern, action, effective (date). Changes collapse to one a day before the window sees them.
    """
    days = entries.where("effective is not null and pattern is not null").groupBy("list_name", "pattern", "effective").agg(F.max(F.col("action") == "remove").alias("gone"))
    following = F.lead("effective").over(W.partitionBy("list_name", "pattern").orderBy("effective"))
    return days.withColumn("valid_to", following).where("not gone").select("list_name", "pattern", F.col("effective").alias("valid_from"), "valid_to")


def candidates(captures: DataFrame, labels: int, segments: int) -> DataFrame:
    """captures and `key`: a row for each pattern of up to so many labels or segments that matches its URL."""
    rows = captures.withColumns({"_host": F.split(host_of(F.col("url")), r"\."), "_path": segments_of(F.col("url"))}).where("_host[0] <> '' or size(_host) > 1")
    domains = F.expr(f"transform(sequence(1, least({max(1, labels)}, size(_host))), k -> concat('d:', array_join(slice(_host, -k, k), '.')))")
    paths = F.expr(f"CASE WHEN {segments} > 0 AND size(_path) > 0 THEN transform(sequence(1, least({max(1, segments)}, size(_path))), k -> concat('p:', array_join(_host, '.'), '/', array_join(slice(_path, 1, k), '/'))) ELSE array() END")
    return rows.withColumn("key", F.explode(F.concat(domains, paths))).drop("_host", "_path")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures and n_active (long), first_list, blocked. captures: page_id, url, fetched_on (date)."""
    spans = intervals(entries)
    most = entries.select(
        F.max(F.when(F.col("pattern").startswith("d:"), F.size(F.split("pattern", r"\.")))),
        F.max(F.when(F.col("pattern").startswith("p:"), F.size(F.split("pattern", "/")) - 1)),
    ).first()
    slim = captures.select("page_id", "url", "fetched_on").withColumn("_mark", F.xxhash64("url")).distinct()
    keys = candidates(slim, most[0] or 0, most[1] or 0).drop("url")
    active = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    hits = keys.join(spans, keys["key"] == spans["pattern"]).where(active)
    found = hits.groupBy("page_id", "_mark", "fetched_on").agg(F.count("*").alias("_n"), F.min("list_name").alias("_l"))
    found = found.withColumnsRenamed({"page_id": "_id", "fetched_on": "_day"})
    rows = captures.withColumn("_own", F.xxhash64("url"))
    rows = rows.join(found, rows["page_id"].eqNullSafe(found["_id"]) & (rows["_own"] == found["_mark"]) & (rows["fetched_on"] == found["_day"]), "left")
    return rows.select(*captures.columns, F.coalesce("_n", F.lit(0)).alias("n_active"), F.col("_l").alias("first_list"), F.col("_n").isNotNull().alias("blocked"))


def day(n: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def md5_number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def demo_captures(pages: DataFrame) -> DataFrame:
    """pages with a day of capture; the table has none."""
    return pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 37, F.lit(366))).alias("fetched_on"))


def demo_entries(pages: DataFrame) -> DataFrame:
    """A history of lists over the hosts and first path segments of pages: some are added, removed and added again."""
    host, first = host_of(F.col("url")), F.get(segments_of(F.col("url")), F.lit(0))
    names = pages.select(F.explode(F.array(F.concat(F.lit("d:"), host), F.concat(F.lit("p:"), host, F.lit("/"), first))).alias("pattern")).where("pattern is not null").distinct()
    named = names.withColumn("m", md5_number(F.col("pattern"))).where("m % 3 = 0")
    steps = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("after")) for a, d in (("add", 0), ("remove", 60), ("add", 150))])
    rows = named.withColumn("s", F.explode(steps))
    return rows.select(F.concat(F.lit("list"), (F.col("m") % 7).cast("string")).alias("list_name"), "pattern", F.col("s.action").alias("action"), day(F.col("m") % 200 + F.col("s.after")).alias("effective"))


def demo(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return evaluate(demo_captures(pages), demo_entries(pages)).select("page_id", F.col("fetched_on").cast("string"), "n_active", "first_list", "blocked")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched_on,
    lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS seg
  FROM pages),
p AS (
  SELECT DISTINCT pattern FROM (SELECT unnest(['d:' || host, 'p:' || host || '/' || seg[1]]) AS pattern FROM c) WHERE pattern IS NOT NULL),
n AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::UBIGINT::BIGINT AS m FROM p),
e AS (
  SELECT 'list' || (m % 7) AS list_name, pattern, s.action AS action, DATE '2024-01-01' + CAST(m % 200 + s.after AS INTEGER) AS effective
  FROM (SELECT *, unnest([{'action': 'add', 'after': 0}, {'action': 'remove', 'after': 60}, {'action': 'add', 'after': 150}]) AS s FROM n WHERE m % 3 = 0)),
i AS (
  SELECT * FROM (SELECT *, lead(effective) OVER (PARTITION BY list_name, pattern ORDER BY effective) AS valid_to FROM e) WHERE action = 'add'),
h AS (
  SELECT c.page_id, i.list_name FROM c JOIN i
    ON ((i.pattern[1:2] = 'd:' AND (c.host = i.pattern[3:] OR c.host LIKE '%.' || i.pattern[3:]))
     OR (i.pattern[1:2] = 'p:' AND i.pattern[3:] = c.host || '/' || c.seg[1]))
   AND c.fetched_on >= i.effective AND (i.valid_to IS NULL OR c.fetched_on < i.valid_to))
SELECT c.page_id, CAST(c.fetched_on AS VARCHAR) AS fetched_on, count(h.list_name)::BIGINT AS n_active, min(h.list_name) AS first_list, count(h.list_name) > 0 AS blocked
FROM c LEFT JOIN h ON c.page_id = h.page_id GROUP BY c.page_id, c.fetched_on
"""

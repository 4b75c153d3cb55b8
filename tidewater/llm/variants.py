"""Spelling variants: words one code point apart, each led to the form that is written most.

Near words are found without ever making a pair of them. A word of length L has L wildcard groups, one for each position:
(position, prefix, suffix). All words of a group differ from each other by one replaced code point, so what a member
needs of its group is its size and its two most frequent words: the best near word is the first of them, or the second
for the first itself. For indels a word's L distinct deletions join the vocabulary: a group of deletions that holds a
whole word gives that word the group's size and best word, and gives every other member that one whole word. Sizes add
up, as no word is near another in two ways.

A group's key is its position and four sums modulo 2^31 - 1 of the remaining code points, so a word costs rows of fixed
size in proportion to its length, however long it is. Words are numbered by (most occurrences, then code points), so
groups hold numbers, and the smallest of them is the best. A group has as many members as the alphabet has letters at
most (deletions: times the word's length), which bounds what is gathered in a row.

Chains of forms end, since each form has at least twice the occurrences of the word before. They are followed by pointer
jumping: rounds grow with the logarithm of the longest chain.

Defined results: a null text has no runs; a null id is an empty id; runs are cut at any other character, whatever the
text's length; words of equal count are ordered by code points; repeated rows count again; further columns of the table,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded

#: Runs of letters, as a character class that Java, Python and RE2 read alike.
RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The lanes of a key: bases of sums modulo PRIME.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_013, 214_013_531, 1_566_083_941)
#: Rows of a batch of keys.
BATCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    every: int = 97  # of runs, one in so many loses a code point; 0: none


def counted(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select("id", run.alias("word"))
    if settings.every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % settings.every == 0, cut).otherwise(F.col("word")).alias("word"))
    long = runs.where(F.char_length("word") >= settings.least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least_count)


def keys(vocabulary: DataFrame) -> DataFrame:
    """(at, a, b, rank, whole): a word's wildcard groups (at: the position), its deletions and itself (at: -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rank, words = x.column(0).to_numpy(), x.column(1).to_pylist()
            begin = 0
            while begin < len(words):  # some words at a time, by their letters
                end, letters = begin, 0
                while end < len(words) and (end == begin or letters + len(words[end]) <= BATCH):
                    letters += len(words[end])
                    end += 1
                yield from _keys(rank[begin:end], words[begin:end])
                begin = end

    return vocabulary.select("rank", "word").mapInArrow(run, "at int, a long, b long, rank long, whole boolean")


def _keys(rank: np.ndarray, words: list[str]) -> Iterator[pa.RecordBatch]:
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code)) - start[word]
    wild, rest, whole = [], [], []
    for base in BASES:
        power = _powers(base, int(size.max()))
        term = code * power[at] % PRIME
        before = np.cumsum(term) - term
        before -= before[start][word]
        total = np.add.reduceat(term, start)
        behind = total[word] - before - term  # of the letters after this one, which move up by one place when it goes
        wild.append((before + behind) % PRIME)
        rest.append((before + behind % PRIME * pow(base, -1, PRIME)) % PRIME)
        whole.append(total % PRIME)
    # equal neighbours leave the same rest when they go: the first of them stands for all
    first = (at == 0) | (code != np.roll(code, 1))
    for lanes, places, of, is_whole in ((wild, at, word, False), ([r[first] for r in rest], np.full(int(first.sum()), -1), word[first], False), (whole, np.full(len(words), -1), np.arange(len(words)), True)):
        a, b, r = lanes[0] << 31 | lanes[1], lanes[2] << 31 | lanes[3], rank[of]
        for s in range(0, len(a), BATCH):
            e = min(len(a), s + BATCH)
            held = pa.array(np.full(e - s, is_whole))
            yield pa.RecordBatch.from_arrays([pa.array(places[s:e].astype(np.int32)), pa.array(a[s:e]), pa.array(b[s:e]), pa.array(r[s:e]), held], ["at", "a", "b", "rank", "whole"])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[:n]


def near(keyed: DataFrame) -> DataFrame:
    """(rank, n_near, best): of every word with a near word, how many it has and the first of them."""
    groups = keyed.groupBy("at", "a", "b").agg(F.array_sort(F.collect_list(F.struct("rank", "whole"))).alias("m"), F.max("whole").alias("has")).where("size(m) > 1 and (at >= 0 or has)")
    m = F.col("m")
    told = lambda rank, n, best: F.struct(rank.alias("rank"), n.cast("long").alias("n"), best.alias("best"))
    wild = F.transform(m, lambda x: told(x["rank"], F.size(m) - 1, F.when(x["rank"] == m[0]["rank"], m[1]["rank"]).otherwise(m[0]["rank"])))
    word, cut = F.filter(m, lambda x: x["whole"])[0]["rank"], F.filter(m, lambda x: ~x["whole"])
    indel = F.concat(F.array(told(word, F.size(cut), cut[0]["rank"])), F.transform(cut, lambda x: told(x["rank"], F.lit(1), word)))
    each = groups.select(F.explode(F.when(F.col("at") >= 0, wild).otherwise(indel)).alias("x")).select("x.*")
    return each.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, cuts: Cuts) -> DataFrame:
    """(rank, root) of every word with a form: chains of (rank, form_rank) followed to their ends by pointer jumping."""
    now = cuts.write(forms.where("form_rank is not null").select("rank", F.col("form_rank").alias("root"), F.lit(True).alias("open")))
    while not now.where("open").isEmpty():
        ahead = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        jumped = now.join(ahead, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open"))
        was, now = now, cuts.write(jumped)
        cuts.drop(was)
    return now.select("rank", "root")


def variants(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word. docs: doc_id, text."""
    settings = settings or Settings()
    cuts = Cuts(docs.sparkSession)
    # a written order: the number of a word is its place among all words
    ordered = counted(docs, settings).orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id())
    vocabulary = cuts.write(ordered)
    with bounded(docs.sparkSession):
        close = cuts.write(near(keys(vocabulary)))
    best = vocabulary.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    held = vocabulary.join(close, "rank", "left").join(best, "best", "left")
    enough = F.col("form_n") >= settings.ratio * F.col("n")
    forms = cuts.write(held.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(enough, F.col(c)).alias(k) for c, k in (("best", "form_rank"), ("form", "form"), ("form_n", "form_n"))]))
    cuts.drop(close)
    ends = roots(forms, cuts).join(vocabulary.select(F.col("rank").alias("root"), F.col("word").alias("end")), "root").select("rank", "end")
    return forms.join(ends, "rank", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


class CRC:
    """crc32 in SQL: a table of one row, crc (t), and an expression over it."""

    _steps = "list_reduce(range(8), lambda a, j: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)"
    table = f"crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: {_steps}) AS t)"

    @staticmethod
    def of(text: str) -> str:
        """Of a text without code points over U+07FF."""
        octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
        return f"xor(list_reduce({octets}, lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE {CRC.table},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {CRC.of("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM d, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY ALL),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM k),
pairs AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = p || s
  UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = p || s),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(w := other, n := m), (-m, other)) AS b FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.w END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.at AND e.form IS NULL
"""

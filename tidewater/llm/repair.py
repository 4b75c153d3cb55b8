"""Conversation structure repair: the cheapest edits after which a conversation reads system?, then user and assistant in turns.

A row's role and fault are one letter, a conversation's rows in order are a short string, its signature. Most
conversations share few signatures, so each distinct one is solved once, by recursion over its suffixes with memory:
what a suffix costs depends only on the state before it (nothing yet, behind system, user or assistant), so a step maps
four costs to four costs, and steps are remembered by letter and costs. Reading costs from the front gives the edits; of
equally cheap ones the letter that comes first, as a state and a letter have one next state only. Audits are joined back
by signature and replayed over the rows.

Rows are streamed over sorted partitions twice, once to write signatures, once behind their audit to hash what is
repaired: a conversation holds a letter a row in memory, no texts. Seen texts are told by a window over role and digest.

Defined results: rows are ordered by turn (nulls first), role, text; a null conv_id is one conversation; nulls in texts,
roles and keys are one space; a role without a letter of its own can only be re-roled or deleted; repeated rows are
duplicates; a conversation without rows is repaired as it is; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Cuts, bounded
from tidewater.llm.variants import CRC

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits, and of leaving a truncated row in.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, behind system, behind user, behind assistant. What may come next but system, and the state then.
NEEDS, NEXT, ROLES = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}
#: What is missing when a conversation ends in a state.
END = (0, 2 * INSERT, INSERT, 0)
#: Suffixes are solved from the end in strides, so recursion is never deeper.
STRIDE = 200
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with faults put in by the checksum of conversation and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone) with their first fault."""
    from pyspark.sql import Window as W

    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = W.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256), "gone").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(end == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", F.when(~F.col("gone"), fault))


def letter() -> Column:
    """A row's letter: its role's (x: none), a capital if truncated; d if it must go."""
    role = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)


def _sorted(rows: DataFrame, first: Column | str = "turn", last: Column | str = "text") -> DataFrame:
    """Conversations in partitions, rows in order. Of equal rows the duplicates come last, if `last` says so."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", first, "turn", "role", "text", last)


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id (a string), COUNTS and the signature of every conversation of faulty rows."""
    schema = pa.schema([("conv_id", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("signature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def finished() -> dict:
            gaps = now["last"] - now["least"] + 1 - now["distinct"] if now["distinct"] else 0
            return {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in COUNTS[1:]}, "signature": now["letters"].decode()}

        for x in batches:
            for conv_id, turn, initial, fault, letter, gone in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if now is None or now["conv_id"] != conv_id:
                    if now is not None:
                        done.append(finished())
                    now = {"conv_id": conv_id, "letters": bytearray(), "before": None, "least": 0, "last": None, "distinct": 0, **dict.fromkeys(COUNTS, 0)}
                if gone:
                    continue
                if turn is not None and turn != now["last"]:
                    now["least"] = turn if now["last"] is None else now["least"]
                    now["last"], now["distinct"] = turn, now["distinct"] + 1
                if fault:
                    now[fault] += 1
                now["illegal"] += now["before"] is not None and now["before"] + initial not in ("su", "ua", "au")
                now["before"] = initial
                now["letters"] += letter.encode()
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([finished()], schema)

    seen = _sorted(rows, last=F.coalesce(F.col("fault") == "duplicate", F.lit(False))).select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), F.substring("role", 1, 1), "fault", letter(), "gone")
    return seen.mapInArrow(run, ", ".join(["conv_id string", *[f"{c} long" for c in COUNTS], "signature string"]))


@lru_cache(1 << 16)
def _step(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs by state before a row and what follows it, from those behind the row: the least, and each less the least."""
    out = [min(c + after[q] for _, c, q in _moves(letter, p)) for p in range(4)]
    for p in (2, 3, 2, 0, 1):  # insertions lead from user to assistant and from any other state to user
        out[p] = min(out[p], INSERT + out[NEXT[p]])
    return min(out), tuple(c - min(out) for c in out)


def _moves(letter: str, p: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, state behind it) of a row's edits in state p, in the order of their letters."""
    yield "D", DELETE, p
    if letter == "d":
        return
    more, role = TRUNCATED * letter.isupper(), letter.lower()
    if role == "s" and p == 0:
        yield "K", more, 1
    elif role == NEEDS[p]:
        yield "K", more, NEXT[p]
    yield "R", REROLE + more, NEXT[p]


def solve(signature: str) -> tuple[str, int]:
    """The audit and its cost."""
    n = len(signature)
    known: list[tuple[int, tuple[int, ...]] | None] = [None] * n + [(0, END)]

    def cost(i: int) -> tuple[int, tuple[int, ...]]:
        """Of the suffix from row i, by state: the least, and each less the least."""
        if known[i] is None:
            least, each = cost(i + 1)
            more, before = _step(signature[i], each)
            known[i] = least + more, before
        return known[i]

    for i in range(n, 0, -STRIDE):
        cost(i)
    total = cost(0)[0] + cost(0)[1][0]
    audit, i, p = [], 0, 0
    while i < n or END[p]:
        here = known[i][0] + known[i][1][p]
        rows = [(e, c, q, i + 1) for e, c, q in _moves(signature[i], p)] if i < n else []
        edit, _, p, i = next(m for m in sorted([*rows, ("I", INSERT, NEXT[p], i)]) if m[1] + known[m[3]][0] + known[m[3]][1][m[2]] == here)
        audit.append(edit)
    return "".join(audit), total


def solved(distinct: DataFrame) -> DataFrame:
    """signature, audit, cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [solve(s) for s in x.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["signature", "audit", "cost"])

    return distinct.select("signature").mapInArrow(run, "signature string, audit string, cost long")


def replay(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """heads (conv_id, COUNTS, cost, audit) and repaired_sha256 of the rows behind their audits."""
    kept = ("conv_id", *COUNTS, "cost", "audit")
    schema = pa.schema([(c, pa.string() if c in ("conv_id", "audit") else pa.int64()) for c in kept] + [("repaired_sha256", pa.string())])
    none = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in kept[1:]]
    both = heads.select(*kept, F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")])
    both = both.unionByName(rows.where("not gone").select("conv_id", *none, F.lit(1).alias("kind"), "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, done = None, None, []

        def insert() -> None:
            while now.audit[now.at : now.at + 1] == "I":
                now.at += 1
                now.put(ROLES[NEEDS[now.state]], "")

        def finished() -> dict:
            insert()
            return dict(zip(kept, head, strict=True)) | {"repaired_sha256": now.sha.hexdigest()}

        for x in batches:
            for *values, kind, role, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        done.append(finished())
                    head, now = values, Repaired(values[-1])
                    continue
                insert()
                edit = now.audit[now.at]
                now.at += 1
                if edit != "D":
                    now.put(role if edit == "K" else ROLES[NEEDS[now.state]], text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([finished()], schema)

    streamed = _sorted(both, "kind").select(F.col("conv_id").cast("string"), *kept[1:], "kind", "role", "text")
    return streamed.mapInArrow(run, ", ".join(f"{c} {'string' if c in ('conv_id', 'audit') else 'long'}" for c in kept) + ", repaired_sha256 string")


class Repaired:
    """What has been repaired of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def put(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        self.state = 1 if role[:1] == "s" else NEXT[self.state]


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, COUNTS, cost, audit, repaired_sha256: one row per conversation of (conv_id, turn, role, text, gone)."""
    spark = rows.sparkSession
    cuts, kind = Cuts(spark), rows.schema["conv_id"].dataType
    with bounded(spark):
        marked = cuts.write(signatures(faults(rows)))
        answers = cuts.write(solved(marked.select("signature").distinct()))
        heads = marked.join(answers, "signature").withColumn("conv_id", F.col("conv_id").cast(kind))
        return cuts.write(replay(heads, rows).withColumn("conv_id", F.col("conv_id").cast(kind)))


_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
ORACLE = f"""
WITH RECURSIVE {CRC.table},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.of(_KEY)} % 20 AS h FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM h WHERE h <> 0)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
f AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS c, CASE WHEN t = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM p),
g AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id),
e AS MATERIALIZED (SELECT conv_id, i, c, role, text, fault IN ('blank', 'duplicate') IS TRUE AS del, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM f),
back AS (
  SELECT conv_id, n AS i, 0 AS v0, 6 AS v1, 3 AS v2, 0 AS v3 FROM g
  UNION ALL
  SELECT conv_id, i - 1, least(b0, 3 + b2, 6 + b3), least(b1, 3 + b2, 6 + b3), least(b2, 3 + b3), least(b3, 3 + b2) FROM (
    SELECT b.conv_id, b.i, least(v0 + 4, CASE WHEN NOT del THEN more + least(v2 + 3, CASE c WHEN 'u' THEN v2 WHEN 's' THEN v1 END) END) AS b0,
      least(v1 + 4, CASE WHEN NOT del THEN more + v2 + CASE WHEN c = 'u' THEN 0 ELSE 3 END END) AS b1,
      least(v2 + 4, CASE WHEN NOT del THEN more + v3 + CASE WHEN c = 'a' THEN 0 ELSE 3 END END) AS b2,
      least(v3 + 4, CASE WHEN NOT del THEN more + v2 + CASE WHEN c = 'u' THEN 0 ELSE 3 END END) AS b3
    FROM back b JOIN e ON e.conv_id = b.conv_id AND e.i = b.i)),
v AS MATERIALIZED (SELECT conv_id, i, [v0, v1, v2, v3] AS v FROM back),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 1 AS p, '' AS audit, []::VARCHAR[] AS lines FROM g
  UNION ALL
  SELECT conv_id, CASE WHEN k = 'I' THEN i ELSE i + 1 END, CASE WHEN k = 'D' THEN p WHEN k = 'K' AND c = 's' THEN 2 WHEN p = 3 THEN 4 ELSE 3 END, audit || k,
    CASE WHEN k = 'D' THEN lines ELSE list_append(lines, CASE WHEN k = 'K' THEN role WHEN p = 3 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN k = 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.*, e.role, e.text, e.c, CASE WHEN x.v[p] = 4 + y.v[p] THEN 'D' WHEN x.v[p] = 3 + x.v[q] THEN 'I' WHEN NOT del AND c = 's' AND p = 1 AND x.v[p] = more + y.v[2] THEN 'K' WHEN NOT del AND c = CASE WHEN p = 3 THEN 'a' ELSE 'u' END AND x.v[p] = more + y.v[q] THEN 'K' ELSE 'R' END AS k
    FROM (SELECT *, CASE WHEN p = 3 THEN 4 ELSE 3 END AS q FROM walk) w JOIN v x ON x.conv_id = w.conv_id AND x.i = w.i LEFT JOIN v y ON y.conv_id = w.conv_id AND y.i = w.i + 1 LEFT JOIN e ON e.conv_id = w.conv_id AND e.i = w.i + 1
    WHERE y.i IS NOT NULL OR p IN (2, 3)))
SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, v[1]::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM g JOIN v ON v.conv_id = g.conv_id AND v.i = 0 JOIN walk ON walk.conv_id = g.conv_id AND walk.i = g.n AND walk.p IN (1, 4)
"""

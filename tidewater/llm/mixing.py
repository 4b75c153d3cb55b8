"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; one aggregation counts each cell's tokens. However many values a
marginal has, each is a level of its own. Raking scales the cells' expected tokens to one marginal after the other until
all hold: up to CELLS cells in arrays on the driver, more in tables, where a scaling is one sum by level and one join
(`rake_tables`); both follow the same targets to the same shares. A cell can't give more tokens than it has, so each scaling is sought under that bound
(a document is never drawn twice); what a marginal lacks because of it is reported, not hidden. A cell's expected
tokens over its tokens are the calibrated sampling probability; a document is kept if its hash falls below its cell's.

Targets are given by level. Where none are, they are tempered: the marginals that cells have whose tokens are raised to
`power` and scaled to the budget under the same bound, so that small sources, languages and topics gain on large ones
and the marginals can hold together. Targets that contradict each other are followed for `rounds` and then reported.
Topic, where there is no such column, is fitted (llm/topics.py).
Defined results: null values and those that targets don't name are OTHER; targets of levels without tokens are dropped
and the rest rescaled; with no target left the corpus' own shares hold; texts without words have no weight and go; rows
with the same id share their fate, null ids are hashed by text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import topics
from tidewater.llm.common import Cuts, bounded_batches, set_aside

OTHER = "(other)"
DIMS = ("source", "lang", "topic")
CELL = [f"_{d}" for d in DIMS]
#: Cells that are raked on the driver at most.
CELLS = 1 << 16


@dataclass(frozen=True)
class Targets:
    """Shares of tokens wanted by level (None: tempered shares of the corpus); budget: the share of all tokens to keep."""

    source: dict[str, float] | None = None
    lang: dict[str, float] | None = None
    topic: dict[str, float] | None = None
    budget: float = 0.6
    power: float = 0.7
    seed: int = 17
    topics: int = 8


@dataclass
class Raked:
    """Expected tokens of each cell, and for each marginal's level the share wanted and that expected. Where cells are
    raked in tables, `cells` (CELL, n, expected) and `levels` (marginal, level, target, expected) hold the same."""

    tokens: dict[tuple[str, ...], int]
    expected: dict[tuple[str, ...], float]
    shares: list[tuple[str, str, float, float]]
    converged: bool
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, topics.WIDTH)))
    named: dict[str, list[str] | None] = field(default_factory=dict)
    cells: DataFrame | None = None
    levels: DataFrame | None = None

    def probability(self, cell: tuple[str, ...]) -> float:
        return self.expected[cell] / self.tokens[cell]


def bounded_factor(y: np.ndarray, most: np.ndarray, wanted: float) -> float:
    """a such that min(most, a * y) sums to wanted; if all of most is too little, one that reaches all."""
    if wanted <= 0 or not len(y):
        return 0.0
    order = np.argsort(most / y, kind="stable")
    y, most = y[order], most[order]
    full = np.concatenate(([0.0], np.cumsum(most)[:-1]))  # of those that reach their bound before
    rest = np.cumsum(y[::-1])[::-1]
    a = (wanted - full) / rest
    fits = a <= most / y
    return float(a[fits.argmax()]) if fits.any() else float(most[-1] / y[-1])


def tempered(tokens: np.ndarray, total: float, power: float) -> np.ndarray:
    """Tokens of cells raised to a power and scaled to the total, none above what it has."""
    y = tokens**power
    return np.minimum(tokens, bounded_factor(y, tokens, total) * y)


def wanted_shares(tokens: np.ndarray, level: np.ndarray, names: list[str], target: dict[str, float] | None, total: float, power: float) -> np.ndarray:
    t = np.bincount(level, weights=tempered(tokens, total, power) if target is None else tokens, minlength=len(names))
    if target is not None and sum(target.get(n, 0.0) for n in names) > 0:
        t = np.array([target.get(n, 0.0) for n in names])
    return t / t.sum()


def rake(counts: dict[tuple[str, ...], int], targets: Targets, tolerance: float = 1e-9, rounds: int = 2000) -> Raked:
    """Expected tokens of cells in the proportions of their counts, none above its count, whose marginals are the targets."""
    cells = sorted(counts)
    n = np.array([counts[c] for c in cells], float)
    total = targets.budget * n.sum()
    axes = []
    for i, d in enumerate(DIMS):
        names = sorted({c[i] for c in cells})
        place = {name: k for k, name in enumerate(names)}
        level = np.array([place[c[i]] for c in cells])
        members = np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level, minlength=len(names)))[:-1])
        axes.append((names, level, wanted_shares(n, level, names, getattr(targets, d), total, targets.power), members))
    factors = [np.ones(len(names)) for names, *_ in axes]
    x, worst = n * targets.budget, np.inf
    for _ in range(rounds):
        worst = 0.0
        for i, (_, _, want, members) in enumerate(axes):
            y = n * targets.budget
            for j, (_, level, *_) in enumerate(axes):
                if j != i:
                    y = y * factors[j][level]
            for k, at in enumerate(members):
                live = at[y[at] > 0]
                worst = max(worst, abs(x[at].sum() - want[k] * total) / max(total, 1.0))
                factors[i][k] = bounded_factor(y[live], n[live], want[k] * total)
                x[at] = np.minimum(n[at], factors[i][k] * y[at])
        if worst < tolerance:
            break
    share = lambda i, k: float(x[axes[i][3][k]].sum() / max(x.sum(), 1e-300))
    shares = [(d, name, float(axes[i][2][k]), share(i, k)) for i, d in enumerate(DIMS) for k, name in enumerate(axes[i][0])]
    return Raked(dict(counts), dict(zip(cells, x.tolist(), strict=True)), shares, worst < tolerance)


def rake_tables(cells: DataFrame, targets: Targets, cuts: Cuts, tolerance: float = 1e-6, rounds: int = 200) -> Raked:
    """The same in tables. cells: (CELL, n). A level's factor moves by one step of Newton's towards what it lacks: its
    tokens are a concave function of it, so steps end where the sorted search on the driver ends."""
    n = F.col("n").cast("double")
    tokens = cells.agg(F.sum("n").alias("n")).first()["n"]
    total = targets.budget * tokens

    def root(y, least: float) -> float:
        """a such that min(n, a * y) sums to the total."""
        a = 0.0
        for _ in range(100):
            r = cells.agg(F.sum(F.when(n <= a * y, n).otherwise(0.0)).alias("full"), F.sum(F.when(n > a * y, y)).alias("rest")).first()
            if not r["rest"] or abs(r["full"] + a * r["rest"] - total) <= least * total:
                return a
            a = (total - r["full"]) / r["rest"]
        return a

    want = {}
    for d in DIMS:
        level, target = F.col(f"_{d}"), getattr(targets, d)
        if target is None:
            y = F.pow(n, F.lit(targets.power))
            each = F.least(n, F.lit(root(y, 1e-12)) * y)
        else:
            each = None
        sums = cells.groupBy(level.alias("level")).agg(F.sum(n if each is None else each).alias("t"))
        if target is not None:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], "level string, w double")
            sums = cuts.write(sums.join(given, "level", "left").withColumn("w", F.coalesce("w", F.lit(0.0))))
            sums = sums.select("level", (F.col("w") if sums.agg(F.sum("w")).first()[0] > 0 else F.col("t")).alias("t"))
        whole = sums.agg(F.sum("t")).first()[0]
        want[d] = cuts.write(sums.select("level", (F.col("t") / whole).alias("want")))
    now = cuts.write(cells.select(*CELL, n.alias("n"), *[F.lit(1.0).alias(f"f_{d}") for d in DIMS]))
    worst, x = np.inf, lambda d: reduce(lambda a, b: a * b, [F.col(f"f_{j}") for j in DIMS if j != d], F.col("n") * targets.budget)
    for _ in range(rounds):
        worst = 0.0
        for d in DIMS:
            y, a = x(d), F.col(f"f_{d}")
            sums = now.groupBy(F.col(f"_{d}").alias("level")).agg(F.max(a).alias("a"), F.sum(F.when(F.col("n") <= a * y, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(F.col("n") > a * y, y).otherwise(0.0)).alias("rest"))
            lacks = F.col("want") * total - F.col("full")
            moved = F.when(F.col("want") <= 0, 0.0).when(F.col("rest") > 0, F.greatest(lacks, F.lit(0.0)) / F.col("rest")).otherwise(F.col("a"))
            # a factor under which every cell of a level is full may be too large by far: it starts again from below
            over = (F.col("rest") <= 0) & (lacks < 0)
            new = cuts.write(sums.join(want[d], "level").select("level", F.when(over, F.col("a") / 2).otherwise(moved).alias("new"), (F.abs(F.col("full") + F.col("a") * F.col("rest") - F.col("want") * total) / total).alias("off"), ((F.col("rest") <= 0) & (lacks >= 0)).alias("spent")))
            worst = max(worst, new.where("not spent").agg(F.max("off")).first()[0] or 0.0)
            was, now = now, cuts.write(now.join(new.select(F.col("level").alias(f"_{d}"), "new"), f"_{d}").select(*CELL, "n", *[F.col("new" if j == d else f"f_{j}").alias(f"f_{j}") for j in DIMS]))
            cuts.drop(was)
            cuts.drop(new)
        if worst < tolerance:
            break
    full = cuts.write(now.select(*CELL, F.col("n").cast("long").alias("n"), F.least(F.col("n"), x(None)).alias("expected")))
    drawn = full.agg(F.sum("expected")).first()[0] or 1e-300
    levels = [full.groupBy(F.col(f"_{d}").alias("level")).agg((F.sum("expected") / drawn).alias("expected")).join(want[d], "level").select(F.lit(d).alias("marginal"), "level", F.col("want").alias("target"), "expected") for d in DIMS]
    levels = cuts.write(reduce(DataFrame.union, levels))
    cuts.only(full, levels)
    return Raked({}, {}, [], worst < tolerance, cells=full, levels=levels)


def leveled(rows: DataFrame, named: dict[str, list[str] | None]) -> DataFrame:
    """rows with their values of DIMS as levels: OTHER stands for null, and for what isn't among the named ones, if any are."""

    def level(d: str):
        value = F.col(f"_{d}")
        if named.get(d) is None:
            return F.coalesce(value, F.lit(OTHER))
        return F.when(value.isin(*named[d]), value).otherwise(OTHER) if named[d] else F.lit(OTHER)

    return rows.withColumns({f"_{d}": level(d) for d in DIMS})


def topic_name(at: np.ndarray) -> pa.Array:
    return pa.array(pd.Series(at, dtype=object).map(lambda k: None if k < 0 else f"topic{k}"), pa.string())


def fit(docs: DataFrame, targets: Targets, cuts: Cuts) -> Raked:
    """Topics, the named levels of each marginal, and the raked cells."""
    bounded_batches(docs.sparkSession)
    own = "topic" in docs.columns
    values = docs.select("text", *[F.col(d).cast("string").alias(f"_{d}") if d != "topic" or own else F.lit(None).cast("string").alias("_topic") for d in DIMS])
    rows = cuts.write(topics.hashed(values, *CELL))
    centroids = np.zeros((0, topics.WIDTH)) if own else topics.fit(rows, targets.topics, cuts)[0]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = topics.nearest(topics.stacked(x.column(4)), centroids) if len(centroids) else np.full(x.num_rows, -1)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2) if own else topic_name(at), x.column(3)], [*CELL, "n"])

    cells = cuts.write(rows.mapInArrow(label, ", ".join(f"{c} string" for c in CELL) + ", n long").groupBy(*CELL).agg(F.sum("n").alias("n")).where("n > 0"))
    named = {d: None if (target := getattr(targets, d)) is None else [k for k in target if k != OTHER] for d in DIMS}
    found = cuts.write(leveled(cells, named).groupBy(*CELL).agg(F.sum("n").alias("n")))
    cuts.only(found)
    if found.count() > CELLS:
        raked = rake_tables(found, targets, cuts)
    else:
        counts = {tuple(r[c] for c in CELL): r["n"] for r in found.collect()}  # CELLS at most
        raked = rake(counts, targets) if counts else Raked({}, {}, [], True)
        cuts.only()
    raked.centroids, raked.named = centroids, named
    return raked


def labelled(docs: DataFrame, raked: Raked, seed: int) -> DataFrame:
    """docs and _source, _lang, _topic (levels), _n (words) and _u, the document's place in [0, 1)."""
    centroids = raked.centroids

    @F.arrow_udf("struct<n long, topic string>")
    def words_and_topic(text: pa.Array) -> pa.Array:
        v, n = topics.vectors(text)
        at = topics.nearest(v, centroids) if len(centroids) else np.full(len(n), -1)
        return pa.StructArray.from_arrays([pa.array(n), topic_name(at)], ["n", "topic"])

    h = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    out = docs.withColumn("_made", words_and_topic("text"))
    values = {f"_{d}": F.col(d).cast("string") for d in DIMS if d in docs.columns} | ({} if "topic" in docs.columns else {"_topic": F.col("_made.topic")})
    return leveled(out.withColumns(values | {"_n": F.col("_made.n"), "_u": F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))}), raked.named).drop("_made")


def shares(raked: Raked, like: DataFrame) -> DataFrame:
    """(marginal, level, target, expected, shortfall): shares of tokens; shortfall: what the bound of one draw a document costs."""
    if raked.levels is not None:
        return raked.levels.withColumn("shortfall", F.greatest(F.lit(0.0), F.col("target") - F.col("expected")))
    rows = [(d, k, t, e, max(0.0, t - e)) for d, k, t, e in raked.shares]
    return like.sparkSession.createDataFrame(rows, "marginal string, level string, target double, expected double, shortfall double")


def mixed(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """docs and weight (the cell's share of expected tokens), probability, kept; helper columns stay too."""
    targets = targets or Targets()
    raked = fit(docs, targets, Cuts(docs.sparkSession))
    if raked.cells is not None:
        total = raked.cells.agg(F.sum("expected")).first()[0] or 1.0
        cells = raked.cells.select(*CELL, (F.col("expected") / total).alias("weight"), (F.col("expected") / F.col("n")).alias("probability"))
    else:
        total = sum(raked.expected.values()) or 1.0
        cells = docs.sparkSession.createDataFrame([(*k, x / total, raked.probability(k)) for k, x in sorted(raked.expected.items())], ", ".join(f"{c} string" for c in CELL) + ", weight double, probability double")
        cells = F.broadcast(cells)  # CELLS rows at most
    rows = labelled(docs, raked, targets.seed).join(cells, CELL, "left")
    some = F.col("_n") > 0
    rows = rows.withColumns({k: F.when(some, F.coalesce(k, F.lit(0.0))).otherwise(0.0) for k in ("weight", "probability")})
    return rows.withColumn("kept", F.col("_u") < F.col("probability"))


def sample(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The kept rows with their own columns."""
    rows, back = set_aside(docs, "doc_id", "text", *DIMS)
    return back(mixed(rows, targets).where("kept"))

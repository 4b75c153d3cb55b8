"""Quality rules: fixed base rules, then robust multivariate outliers by minimum covariance determinant.

Every step is DataFrame code. One pass over the texts gives counts and a vector of transformed statistics in integer
thousandths, so that all later sums are exact and don't depend on how rows are dealt. Per language and source (or, for
small groups, language or all rows) the estimate seeks the share SUPPORT of rows whose covariance, with floors on its
diagonal, has the least determinant: from three starts (medians with median deviations, with the correlation of
hyperbolic tangents, and with that of spatial signs), concentration steps take the rows nearest by Mahalanobis distance
and estimate mean and covariance anew. Rows at the edge count in part, so that a step's weight is exactly the share; a
step then never raises the determinant but for the grid in which distances are ranked, and one that hardly lowers it
ends its start. Of the starts the least determinant counts. The estimate is scaled to the chi-square median; rows
beyond the cut-off are rejected. Groups are reduced by partial aggregation (sums, and exact percentiles over a few
thousand distinct values) and joined back as one row each.

Defined results: null texts have no words and fail the base rule; null languages and sources form groups of their own;
groups with under MIN_ROWS rows that pass the base rules are judged by the estimate of their language, and if that has
too few as well, by that of all rows, however few; `drop_rejected` keeps further columns, whatever their names; an empty table gives no rows; repeated rows are judged row by row. A
window of three words is compared by its 64-bit hash within its own text.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, Cuts, set_aside

SYMBOLS = "#*$%&|<>"
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
P = len(FEATURES)
#: A feature's deviation counts as this many thousandths at least: a group in which hardly any text has symbols must
#: not turn the first symbol into an outlier.
FLOORS = (300, 100, 400, 400, 400)
MIN_ROWS, SUPPORT = 50, 0.75
#: A step must lower the log of the determinant by this much to be followed by another; there are so many at most.
LOWER, STEPS = 1e-3, 30
CHI2_MEDIAN = 4.351460191095526  # chi-square, 5 degrees of freedom
CUTOFF = 36.0  # of a chi-square with 5 degrees of freedom: a normal vector lies beyond it once in a million
GROUP = ("lang", "source")
#: Whose estimate judges a row: level 0 is its group, 1 its language, 2 all rows.
JUDGE = ("level", "judge_lang", "judge_source")
START = (*JUDGE, "start")
MEANS, FACTOR = [f"m{j}" for j in range(P)], [f"l{j}{k}" for j in range(P) for k in range(j + 1)]


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, row by row.

    Filter on these only once they are written: a filter pushed below would evaluate the arrays inside their own lambdas.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    x = docs.withColumns({"_w": F.array_remove(F.split(text, f"[{SPACE}]+"), ""), "_l": lines})
    x = x.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(text, blank, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.expr("slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, greatest(size(_w) - 2, 0))"),
        }
    ).drop("_w", "_l")
    # windows sorted by hash: equal neighbours are repeats; skipped where all are distinct
    x = x.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) ELSE array() END")).drop("_h")
    x = x.withColumn("_r", F.expr("sort_array(transform(filter(_s, (x, i) -> coalesce(x.h = get(_s, i - 1).h, false) OR coalesce(x.h = get(_s, i + 1).h, false)), x -> x.i))")).drop("_s")
    x = x.withColumn("n_repeat_words", F.expr("aggregate(transform(_r, (p, i) -> least(3, coalesce(get(_r, i + 1) - p, 3))), 0L, (a, v) -> a + v)")).drop("_r")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.withColumn("base_failed", failed)


def with_features(x: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = (
        F.log(words.cast("double")),
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(10 * F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))),
        F.log1p(10 * F.col("n_repeat_words") / words),
    )
    return x.withColumns({k: F.round(1000 * v).cast("long") for k, v in zip(FEATURES, values, strict=True)}).drop("_lines")


def on_group(rows: DataFrame, groups: DataFrame, how: str = "inner", by: tuple[str, ...] = JUDGE) -> DataFrame:
    g = groups.withColumnsRenamed({k: f"_{k}" for k in by})
    return rows.join(g, reduce(lambda a, b: a & b, (rows[k].eqNullSafe(g[f"_{k}"]) for k in by)), how).drop(*(f"_{k}" for k in by))


def judges(rows: DataFrame) -> DataFrame:
    """GROUP and JUDGE: for each group the smallest of itself, its language and all rows with MIN_ROWS rows to learn from."""
    groups = rows.groupBy(*GROUP).agg(F.count_if(~F.col("base_failed")).alias("n"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= MIN_ROWS, 0).when(F.col("n_lang") >= MIN_ROWS, 1).otherwise(2)
    x = on_group(groups, langs, by=("lang",)).withColumn("level", level)
    return x.select(*GROUP, "level", F.when(F.col("level") < 2, F.col("lang")).alias("judge_lang"), F.when(F.col("level") < 1, F.col("source")).alias("judge_source"))


def learners(rows: DataFrame, judged_by: DataFrame) -> DataFrame:
    """JUDGE and FEATURES: the rows that each judge that is asked for learns from."""
    nothing = F.lit(None).cast("string")
    at = [F.lit(0).alias("level"), F.col("lang").alias("judge_lang"), F.col("source").alias("judge_source")]
    levels = [at, [F.lit(1).alias("level"), at[1], nothing.alias("judge_source")], [F.lit(2).alias("level"), nothing.alias("judge_lang"), nothing.alias("judge_source")]]
    asked = judged_by.select(*JUDGE).distinct()
    return reduce(DataFrame.union, (on_group(rows.select(*by, *FEATURES), asked.where(F.col("level") == k)) for k, by in enumerate(levels)))


def factored(g: DataFrame) -> DataFrame:
    """g and the lower Cholesky factor l of its covariance c, and logdet."""
    for k in range(P):
        g = g.withColumn(f"l{k}{k}", F.sqrt(F.greatest(F.col(f"c{k}{k}") - total([F.lit(0.0), *[F.col(f"l{k}{i}") ** 2 for i in range(k)]]), F.lit(1.0))))
        g = g.withColumns({f"l{j}{k}": (F.col(f"c{j}{k}") - total([F.lit(0.0), *[F.col(f"l{j}{i}") * F.col(f"l{k}{i}") for i in range(k)]])) / F.col(f"l{k}{k}") for j in range(k + 1, P)})
    return g.withColumn("logdet", 2 * total([F.log(f"l{k}{k}") for k in range(P)]))


def estimate(rows: DataFrame) -> DataFrame:
    """Per start n, means, factor and logdet of the nearest rows, and the logdet before. rows: START, FEATURES, n, before, rank and edge, the rank of
    the last row of the share."""
    part = {"b": F.col("rank") < F.col("edge"), "t": F.col("rank") == F.col("edge")}
    sums = [F.count_if(at).alias(f"n{p}") for p, at in part.items()]
    sums += [F.coalesce(F.sum(F.when(at, F.col(f))), F.lit(0)).alias(f"{p}{j}") for p, at in part.items() for j, f in enumerate(FEATURES)]
    sums += [F.coalesce(F.sum(F.when(at, F.col(FEATURES[j]) * F.col(FEATURES[k]))), F.lit(0)).alias(f"{p}{j}{k}") for p, at in part.items() for j in range(P) for k in range(j + 1)]
    g = rows.groupBy(*START, "n", "before").agg(*sums).withColumn("h", F.ceil(SUPPORT * F.col("n")))
    # rows at the edge have the weight that is left
    g = g.withColumn("w", (F.col("h") - F.col("nb")) / F.col("nt"))
    whole = lambda k: (F.col(f"b{k}") + F.col("w") * F.col(f"t{k}")) / F.col("h")
    g = g.select(*START, "n", "before", *[whole(j).alias(f"m{j}") for j in range(P)], *[whole(f"{j}{k}").alias(f"c{j}{k}") for j in range(P) for k in range(j + 1)])
    g = g.withColumns({f"c{j}{k}": F.col(f"c{j}{k}") - F.col(f"m{j}") * F.col(f"m{k}") + (FLOORS[j] ** 2 if j == k else 0) for j in range(P) for k in range(j + 1)})
    return factored(g).select(*START, "n", *MEANS, *FACTOR, "logdet", "before")


def squared_distance(rows: DataFrame) -> DataFrame:
    """rows joined with their judge's estimate, and d2: the squared Mahalanobis distance by forward substitution."""
    for j in range(P):
        rows = rows.withColumn(f"z{j}", (F.col(FEATURES[j]) - F.col(f"m{j}") - total([F.lit(0.0), *[F.col(f"l{j}{k}") * F.col(f"z{k}") for k in range(j)]])) / F.col(f"l{j}{j}"))
    return rows.withColumn("d2", total([F.col(f"z{j}") ** 2 for j in range(P)]))


def ranked() -> Column:
    """Distances in a fixed grid, fine enough to rank by: thousandths of log(1 + d2)."""
    return F.round(1000 * F.log1p("d2")).cast("long")


def starts(rows: DataFrame) -> DataFrame:
    """Per judge three estimates to begin with, whose logdet is infinite."""
    median = lambda c: F.percentile(c, 0.5)
    centre = rows.groupBy(*JUDGE).agg(F.count("*").alias("n"), *[median(f).alias(f"m{j}") for j, f in enumerate(FEATURES)])
    spread = on_group(rows, centre).groupBy(*JUDGE, "n", *MEANS)
    spread = spread.agg(*[F.greatest(1.4826 * median(F.abs(F.col(f) - F.col(f"m{j}"))), F.lit(float(FLOORS[j]))).alias(f"a{j}") for j, f in enumerate(FEATURES)])
    x = on_group(rows, spread).withColumns({f"z{j}": (F.col(f) - F.col(f"m{j}")) / F.col(f"a{j}") for j, f in enumerate(FEATURES)})
    x = x.withColumn("norm", F.greatest(F.sqrt(total([F.col(f"z{j}") ** 2 for j in range(P)])), F.lit(1e-9)))
    # thousandths again, so that sums are exact
    x = x.withColumns({f"y{j}": F.round(1000 * F.tanh(f"z{j}")).cast("long") for j in range(P)} | {f"s{j}": F.round(1000 * F.col(f"z{j}") / F.col("norm")).cast("long") for j in range(P)})
    pairs = [(j, k) for j in range(P) for k in range(j + 1)]
    g = x.groupBy(*JUDGE, "n", *MEANS, *[f"a{j}" for j in range(P)]).agg(*[F.sum(F.col(f"{v}{j}") * F.col(f"{v}{k}")).alias(f"{v}{j}{k}") for v in "ys" for j, k in pairs])
    like = [{(j, k): F.lit(float(j == k)) for j, k in pairs}] + [{(j, k): F.col(f"{v}{j}{k}") / F.greatest(F.sqrt(F.col(f"{v}{j}{j}").cast("double") * F.col(f"{v}{k}{k}")), F.lit(1.0)) for j, k in pairs} for v in "ys"]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), *[(F.col(f"a{j}") * F.col(f"a{k}") * (r[j, k] + (0.01 if j == k else 0))).alias(f"c{j}{k}") for j, k in pairs]) for i, r in enumerate(like)]))
    g = g.select(*JUDGE, "n", *MEANS, each.alias("e")).select(*JUDGE, "n", *MEANS, "e.*")
    return factored(g).select(*START, "n", *MEANS, *FACTOR, F.lit(float("inf")).alias("logdet"))


def fit(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Per judge the estimate of least determinant and `scale`, by which its squared distances are divided. rows: JUDGE and FEATURES."""
    now, done, kept = cuts.write(starts(rows)), [], [*START, "n", *MEANS, *FACTOR, "logdet"]
    for _ in range(STEPS):
        far = cuts.write(squared_distance(on_group(rows, now)).select(*START, *FEATURES, F.col("logdet").alias("before"), ranked().alias("rank")))
        edge = far.groupBy(*START).agg(F.count("*").alias("n"), F.expr(f"percentile_disc({SUPPORT}) WITHIN GROUP (ORDER BY rank)").alias("edge"))
        new = cuts.write(estimate(on_group(far, edge, by=START)))
        cuts.drop(far)
        lower = F.col("logdet") < F.col("before") - LOWER
        done.append(new.where(~lower).select(kept))
        now = new.where(lower).select(kept)
        if now.isEmpty():
            break
    least = reduce(DataFrame.union, [*done, now]).groupBy(*JUDGE).agg(F.min_by(F.struct("n", *MEANS, *FACTOR, "logdet"), F.struct("logdet", "start")).alias("e"))
    model = cuts.write(least.select(*JUDGE, "e.*"))
    far = squared_distance(on_group(rows, model))
    scale = far.groupBy(*JUDGE).agg((F.expm1(F.percentile(ranked(), 0.5) / 1000) / CHI2_MEDIAN).alias("scale"))
    return cuts.write(on_group(model, scale).withColumn("scale", F.greatest("scale", F.lit(1.0))))


def judge(docs: DataFrame, key: list[str]) -> DataFrame:
    """key columns, the counts, base_failed, distance (null: no row passes the base rules) and kept, for every row of docs."""
    cuts = Cuts(docs.sparkSession)
    counts = statistics(docs)
    rows = cuts.write(with_features(counts).select(*key, *[k for k in GROUP if k not in key], *FEATURES, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    judged_by = cuts.write(judges(rows))
    model = fit(learners(rows.where("not base_failed"), judged_by), cuts)
    out = squared_distance(on_group(on_group(rows, judged_by, by=GROUP), model, "left")).withColumn("distance", F.col("d2") / F.col("scale"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their own columns. Rows are told apart by id and a hash of what is judged."""
    mark = F.xxhash64(*[F.coalesce(F.col(k), F.lit("\x00")) for k in (*GROUP, "text")])
    rows, back = set_aside(docs, "doc_id", "text", *GROUP)
    out = judge(rows.select("doc_id", *GROUP, "text").withColumn("_mark", mark), ["doc_id", "_mark"])
    gone = out.where("not kept").select(F.col("doc_id").alias("_id"), "_mark").distinct()
    marked = rows.withColumn("_judged", mark)
    return back(marked.join(gone, marked["doc_id"].eqNullSafe(gone["_id"]) & (marked["_judged"] == gone["_mark"]), "left_anti"))

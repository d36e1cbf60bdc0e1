"""Quality rules by robust multivariate outliers.

Base counts of every text (words are runs of no ASCII white space): n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words. A text fails the base rules
with fewer than MIN_WORDS words, or if more than a fifth of its words lie in
5-word runs that it holds twice or more.

The others are judged by the minimum covariance determinant (MCD), per language
and source: STATISTICS, transformed so that clean texts are roughly normal, get a
robust centre and scatter, and a text whose squared Mahalanobis distance exceeds
CUTOFF is rejected. The MCD is found as in its deterministic variant: start from
medians and median absolute deviations, then C_STEPS concentration steps, each of
which estimates mean and covariance from the SHARE of rows closest under the
last estimate. A step is one aggregation: rows are added up by group and by a
fine logarithmic bin of their distance, so the cut at SHARE, the mean and the
covariance all come from a table of bins and no row is sorted. FLOOR is added to
each variance, as statistics that are 0 in most texts would have none.

Groups of fewer than MIN_GROUP rows are pooled into one; if that has too few
rows as well, its rows are kept.

Everything is DataFrame functions. Windows run over bins (a few thousand a
group), aggregations are partial, estimates are joined as stored tables.

Defined results: null and empty texts have all counts 0 and fail the base rules.
Null languages or sources are values of their own. Repeated rows count as often
as they occur and get equal verdicts. An empty table gives an empty result;
other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import WHITE, stored

MIN_WORDS = 10
RUN = 5
SYMBOLS = "#*$%&|<>"
MIN_GROUP = 100
SHARE = 0.75
C_STEPS = 4
BINS_PER_OCTAVE = 16
MEDIAN_BIN = 1 / 128

#: name, value from the base counts, and the standard deviation added to its scatter
STATISTICS = [
    ("log_words", lambda: F.log1p(F.col("n_words")), 0.05),
    ("word_length", lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.02),
    ("symbols", lambda: F.sqrt(F.col("n_symbols") / F.col("n_words")), 0.08),
    ("dup_lines", lambda: F.sqrt(F.col("n_dup_lines") / F.col("n_words")), 0.08),
    ("repeats", lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.08),
]
NAMES = [s[0] for s in STATISTICS]
P = len(STATISTICS)
# The covariance of the closest 75 % of normal rows in 5 dimensions is too small
# by 0.75 / P(chi2 with 7 degrees <= 75 % point of chi2 with 5 degrees).
CONSISTENCY = 1.41
# Beyond the 1 - 1e-9 point of chi2 with 5 degrees (52): statistics of clean text have longer tails than normal ones.
CUTOFF = 60.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in RUN-word windows that occur twice or more, the first included."""
    runs = F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda i: F.xxhash64(F.slice(words, i, RUN)))
                  ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            again = F.filter(p, lambda x, i: F.coalesce(x["h"] == F.get(p, i - 1)["h"], F.lit(False))
                             | F.coalesce(x["h"] == F.get(p, i + 1)["h"], F.lit(False)))
            return F.array_sort(F.transform(again, lambda x: x["i"]))

        def total(s: Column) -> Column:
            # Each window adds the words up to the next one, at most its own RUN.
            steps = F.transform(s, lambda x, i: F.least(F.lit(RUN), F.coalesce(F.get(s, i + 1) - x, F.lit(RUN))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(ordered, starts), total)

    return let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep``, the five counts and base_failed of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WHITE + "+"), "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    dup = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    rows = docs.select(*keep, by_word.alias("_w"), F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                       (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"), dup.cast("long").alias("n_dup_lines"))
    n, r = F.col("_w")["n"].cast("long"), F.col("_w")["r"].cast("long")
    return rows.select(*keep, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"),
                       ((n < MIN_WORDS) | (100 * r > 20 * n)).alias("base_failed"))


def per_group(df: DataFrame, name: str) -> DataFrame:
    """A table of one row per group, stored as one file: its size, which decides
    whether joins broadcast it, is then that of its rows and not of many file
    footers, and the rows it is joined with stay where they are."""
    return stored(df.repartition(1), name)


def _median(rows: DataFrame, value: Callable[[str], Column], into: str) -> DataFrame:
    """Median of each statistic per group, to within MEDIAN_BIN, from bin counts."""
    long = rows.select("_g", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.round(value(n) / MEDIAN_BIN).cast("long").alias("b"))
                                                 for i, n in enumerate(NAMES)])).alias("e")).select("_g", "e.d", "e.b")
    bins = long.groupBy("_g", "d", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_g", "d")
    found = (bins.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("all", F.sum("n").over(w))
             .filter(2 * F.col("upto") >= F.col("all")).groupBy("_g", "d").agg((F.min("b") * MEDIAN_BIN).alias("m")))
    return found.groupBy("_g").agg(*[F.max(F.when(F.col("d") == i, F.col("m"))).alias(f"{into}{i}") for i in range(P)])


def _cholesky(cov: Callable[[int, int], Column]) -> list[tuple[str, Column]]:
    """Columns _l{i}{j} of the lower factor, each from those before it."""
    out = []
    for i in range(P):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            out.append((f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"_l{j}{j}")))
    return out


def _estimate(rows: DataFrame, cov: Callable[[int, int], Column], name: str) -> DataFrame:
    """Keep the centre (_m{i}) of ``rows`` and factor its scatter; one stored row per group."""
    cols = [f"_l{i}{j}" for i in range(P) for j in range(i + 1)]
    for n, c in _cholesky(cov):
        rows = rows.withColumn(n, c)
    return per_group(rows.select("_g", *[f"_m{i}" for i in range(P)], *cols), name)


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Add _d2, the squared Mahalanobis distance (null without an estimate)."""
    rows = rows.join(estimate, "_g", "left")
    for i, n in enumerate(NAMES):
        rest = F.col(n) - F.col(f"_m{i}")
        for k in range(i):
            rest = rest - F.col(f"_l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
    return rows.withColumn("_d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0")))


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One C-step: the estimate from the SHARE of rows closest under the last one."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    near = _distance(rows, estimate).withColumn("_b", F.floor(F.log2(F.col("_d2") + 1e-9) * BINS_PER_OCTAVE))
    bins = near.groupBy("_g", "_b").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"c{i}{j}") for i, j in pairs])
    w = Window.partitionBy("_g")
    inside = (bins.withColumn("before", F.sum("n").over(w.orderBy("_b")) - F.col("n")).withColumn("all", F.sum("n").over(w))
              .filter(F.col("before") < SHARE * F.col("all")))
    sums = inside.groupBy("_g").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(P)],
                                    *[F.sum(f"c{i}{j}").alias(f"c{i}{j}") for i, j in pairs])
    sums = sums.withColumns({f"_m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})

    def cov(i: int, j: int) -> Column:
        return (F.col(f"c{i}{j}") / F.col("n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * CONSISTENCY + (STATISTICS[i][2] ** 2 if i == j else 0)

    return _estimate(sums, cov, "mcd")


def judged(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lang: str = "lang", source: str = "source") -> DataFrame:
    """``keep``, the base counts, base_failed, distance and kept of every row."""
    group = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))
    counts = stored(base_counts(docs.withColumn("_g", group), text, (*keep, "_g")), "base-counts")
    good = counts.filter(~F.col("base_failed"))
    sizes = good.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    pooled = F.when(F.col("n") >= MIN_GROUP, F.col("_g")).otherwise(F.lit("pooled"))
    names = per_group(sizes.withColumn("_to", pooled).withColumn("_all", F.sum("n").over(Window.partitionBy("_to"))).select(
        F.col("_g").alias("_from"), "_to", (F.col("_all") >= MIN_GROUP).alias("_enough")), "groups")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(names, F.col("_g") == F.col("_from"), "left").drop("_from", "_g").withColumnRenamed("_to", "_g")

    ok = ~F.col("base_failed") & (F.col("n_words") > 0)
    values = [F.when(ok, make()).alias(n) for n, make, _ in STATISTICS]
    rows = stored(grouped(good).filter("_enough").select("_g", *values), "statistics")

    centre = per_group(_median(rows, F.col, "_m"), "medians")
    spread = _median(rows.join(centre, "_g"), lambda n: F.abs(F.col(n) - F.col(f"_m{NAMES.index(n)}")), "_a")

    def start(i: int, j: int) -> Column:
        return (F.col(f"_a{i}") * 1.4826) ** 2 + STATISTICS[i][2] ** 2 if i == j else F.lit(0.0)

    estimate = _estimate(centre.join(spread, "_g"), start, "mcd")
    for _ in range(C_STEPS):
        estimate = _concentrate(rows, estimate)
    scored = _distance(grouped(counts).select("*", *values), estimate)
    distance = F.when(ok, F.col("_d2"))
    return scored.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
                         (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))

"""Correlation, box-plot, outliers and linear trend.

Spark 4 runs with ANSI on: bare ``corr`` on a zero-variance column raises
DIVIDE_BY_ZERO.  The correlation here is ``try_divide(covar_pop, sd_a*sd_b)``
over pairwise-complete rows -- NULL on zero variance, equal to ``corr``
otherwise.  The matrix of many columns comes from one accumulator pass
(``moments``), trends are single global aggregates; quartiles use sketches and
exact recounts, two passes whose memory never grows with a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import qcol
from ..session import ensure_checkpoint_dir
from .agg import _num
from .moments import correlations


def pair_corr(a, b) -> F.Column:
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Long output (c1, c2, r, n) for every pair c1 < c2 (schema order),
    pairwise-complete; one pass over the data whatever the number of columns."""
    cols = list(cols)
    return correlations(df, cols, [_num(c) for c in cols])


ACCURACY = 10_000  # rank error of the sketches: rows / ACCURACY
MARGIN = 3.0  # brackets reach this many rank errors to either side
SLICES = 1000  # slices of a bracket; the exact neighbours are looked for in one or two of them


def _reads(probs, accuracy: int) -> list[float]:
    """The ranks that a sketch is read at, around each probability."""
    return sorted({min(1.0, max(0.0, p + side * MARGIN / accuracy)) for p in probs for side in (-1, 1)})


def _bracket(p: float, side: int, accuracy: int, n, sketch, low, high):
    """An end of the bracket of probability p; few rows are all inside."""
    x = p + side * MARGIN / accuracy
    edge = low if side < 0 else high
    if x <= 0.0 or x >= 1.0:
        return edge
    return F.when(n < 2 * accuracy, edge).otherwise(sketch[_reads([p], accuracy).index(x)])


def _picked(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, q): the interpolated values of the target ranks.

    counts (keys, _i, _v, _c): the values inside a bracket and how often each occurs (NULL: all rows below it);
    targets (keys, _i, p, _n, _lo, _hi).  Keys are never NULL.  A bracket's rows are first counted by slice; only the values of
    the slices that hold a target rank are sorted, so no task sorts a whole bracket."""
    at = [*keys, "_i"]
    below = counts.filter("_v IS NULL").select(*at, F.col("_c").alias("_below"))
    t = targets.join(below, at, "left")
    h = (F.col("_n") - 1) * F.col("p")
    t = t.select(*at, "p", "_lo", "_hi", (h - F.floor(h)).alias("_fr"), (F.floor(h) - F.coalesce("_below", F.lit(0))).cast("long").alias("_k0"),
                 (F.least(F.floor(h) + 1, F.col("_n") - 1) - F.coalesce("_below", F.lit(0))).cast("long").alias("_k1"))
    place = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SLICES
    flat = (F.col("_hi") <= F.col("_lo")) | (F.abs(F.col("_lo")) == float("inf")) | (F.abs(F.col("_hi")) == float("inf"))
    inside = counts.filter("_v IS NOT NULL").join(t, at).withColumn("_s", F.when(flat, 0).otherwise(F.least(F.lit(SLICES - 1), F.floor(place))).cast("int"))
    before = Window.partitionBy(*at).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    slices = inside.groupBy(*at, "_s", "_k0", "_k1").agg(F.sum("_c").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    holds = lambda k: (F.col("_before") <= F.col(k)) & (F.col(k) < F.col("_before") + F.col("_m"))
    slices = slices.filter(holds("_k0") | holds("_k1")).select(*at, "_s", "_before")
    run = Window.partitionBy(*at, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = inside.join(slices, [*at, "_s"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(run))
    # the value of rank k is the smallest one whose running count exceeds k
    out = near.groupBy(*at, "p", "_fr").agg(F.min(F.when(F.col("_cum") > F.col("_k0"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_cum") > F.col("_k1"), F.col("_v"))).alias("_b"))
    return out.select(*keys, "p", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + F.col("_fr") * (F.col("_b") - F.col("_a"))).alias("q"))


def exact_quantiles(df: DataFrame, value: str, probs, by: str | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(by, p, q): exact linear-interpolation quantiles (pandas / ``quantile_cont``) with bounded memory, for any
    number of groups of any size; NULL is a group like any other.

    Pass 1, per group: count, min, max and a Greenwald-Khanna sketch (``percentile_approx``, rank error <= n / accuracy)
    read around each probability, which brackets the two neighbouring ranks (groups under 2 * accuracy rows use
    [min, max]).  Pass 2: rows below a bracket are only counted, rows inside it collapse map-side to (value, count) -- a
    value repeated a billion times is one row.  ``_picked`` takes the neighbours from those counts.  Brackets stay a
    table; no task holds a whole group, and nothing per group reaches the driver."""
    probs = list(dict.fromkeys(float(p) for p in probs))
    ensure_checkpoint_dir(df.sparkSession)
    v = qcol(value).cast("double")
    base = df.select(F.struct(*([qcol(by).alias("g")] if by else [F.lit(0).alias("g")])).alias("_g"), v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sketch = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.array(*(F.percentile_approx("_v", _reads([p], accuracy), accuracy) for p in probs)).alias("_q"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    end = lambda i, p, side: _bracket(p, side, accuracy, F.col("_n"), F.col("_q")[i], F.col("_mn"), F.col("_mx"))
    ends = F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(p).alias("p"), end(i, p, -1).alias("_lo"), end(i, p, 1).alias("_hi")) for i, p in enumerate(probs)))
    brackets = sketch.select("_g", "_n", ends.alias("_b")).checkpoint(eager=True)  # one row a group, read by both later steps
    held = F.filter("_b", lambda b: F.col("_v") <= b["_hi"])
    cells = base.join(brackets, "_g").select("_g", "_v", F.explode(held).alias("b"))
    cells = cells.select("_g", F.col("b._i").alias("_i"), F.when(F.col("_v") >= F.col("b._lo"), F.col("_v")).alias("_v"))
    counts = cells.groupBy("_g", "_i", "_v").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
    targets = brackets.select("_g", "_n", F.explode("_b").alias("b")).select("_g", "_n", "b.*")
    out = _picked(counts, targets, ["_g"])
    return out.select(*([F.col("_g.g").alias(by)] if by else []), "p", "q")


def boxplot_stats(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """Q1, median, Q3, IQR fences, mean, sample std and outlier count, in two passes: moments and sketch in one row, then the
    exact quartiles and the number of outliers."""
    v = _num(col)
    st = df.agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"),
                F.min(v).alias("min"), F.max(v).alias("max"), *column_sketches([v], (0.25, 0.5, 0.75))).first()
    found = iqr_summary(df, [col], [v], whisker, row=st, median=True)
    lit = lambda c, t="double": F.lit(st[c]).cast(t).alias(c)
    return found.select("q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), F.col("lower").alias("lower_fence"), F.col("upper").alias("upper_fence"),
                        lit("mean"), lit("std"), lit("n", "long"), lit("min"), lit("max"), "n_outliers")


QUARTILES = (0.25, 0.75)


def column_sketches(values, probs=QUARTILES, accuracy: int = ACCURACY) -> list:
    """The aggregates that ``iqr_summary`` needs of each column, to be taken in one pass with others."""
    sketch = lambda v: [F.percentile_approx(v, _reads([p], accuracy), accuracy).alias(f"q{p}") for p in probs]
    return [F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), *sketch(v)).alias(f"_sketch{k}") for k, v in enumerate(values)]


def iqr_summary(df: DataFrame, names, values, threshold: float = 1.5, accuracy: int = ACCURACY, row=None, median: bool = False) -> DataFrame:
    """(column, q1, q3, lower, upper, n_outliers and, if asked for, median) of many double columns in two passes.

    Pass 1 (or the caller's row with ``column_sketches``): all sketches in one row.  They bracket the quartiles, and those the fences.
    Pass 2 counts, for all columns at once, the rows below and the values inside each of these brackets; quartiles, fences and
    the number of outliers are then exact.  Columns without values have no row."""
    names, values = list(names), list(values)
    probs = (0.25, 0.5, 0.75) if median else QUARTILES
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    row = row or (df.agg(*column_sketches(values, probs, accuracy)).first() if names else None)
    bounds, targets, held = [], [], []
    for k in range(len(names)):
        s = row[f"_sketch{k}"]
        if not s["n"]:
            continue
        few = s["n"] < 2 * accuracy
        ends = [(s["lo"], s["hi"]) if few else tuple(s[f"q{p}"]) for p in probs]
        (l1, h1), (l3, h3) = ends[0], ends[-1]
        fences = [l1 - threshold * (h3 - l1), h1 - threshold * (l3 - h1), l3 + threshold * (l3 - h1), h3 + threshold * (h3 - l1)]
        # infinite quartiles: the fences may be anywhere
        fences = [x if math.isfinite(x) else edge for x, edge in zip(fences, (-math.inf, math.inf) * 2)]
        bounds.append([float(x) for x in [*(x for e in ends for x in e), fences[0], max(fences[:2]), min(fences[2:]), fences[3]]])
        held.append(k)
        targets += [(len(held) - 1, i, p, s["n"], float(e[0]), float(e[1])) for i, (p, e) in enumerate(zip(probs, ends))]
    schema = "column string, q1 double, q3 double, lower double, upper double, n_outliers long" + (", median double" if median else "")
    if not held:
        return spark.createDataFrame([], schema)
    b, v, at = F.array(*(F.array(*(F.lit(x) for x in xs)) for xs in bounds))[F.col("c")], F.col("v"), len(probs)
    cell = lambda kind, some, value: F.when(some, F.struct(F.lit(kind).alias("_i"), F.when(value, v).alias("_v")))
    cells = F.array(*(cell(i, v <= b[2 * i + 1], v >= b[2 * i]) for i in range(at)),
                    cell(at, v < b[2 * at + 1], v >= b[2 * at]), cell(at + 1, v > b[2 * at + 2], v <= b[2 * at + 3]))
    long = df.select(F.posexplode(F.array(*(values[k] for k in held))).alias("c", "v")).filter(v.isNotNull())
    long = long.select("c", F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select("c", "x.*")
    counts = long.groupBy("c", "_i", "_v").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)

    t = spark.createDataFrame(targets, "c int, _i int, p double, _n long, _lo double, _hi double")
    of = lambda p, name: F.max(F.when(F.col("p") == p, F.col("q"))).alias(name)
    q = _picked(counts.filter(F.col("_i") < at), t, ["c"]).groupBy("c").agg(of(0.25, "q1"), of(0.75, "q3"), of(0.5, "median"))
    q = q.withColumn("lower", F.col("q1") - threshold * (F.col("q3") - F.col("q1"))).withColumn("upper", F.col("q3") + threshold * (F.col("q3") - F.col("q1")))
    out = F.col("_v").isNull() | ((F.col("_i") == at) & (F.col("_v") < F.col("lower"))) | ((F.col("_i") == at + 1) & (F.col("_v") > F.col("upper")))
    n = counts.filter(F.col("_i") >= at).join(F.broadcast(q), "c").filter(out).groupBy("c").agg(F.sum("_c").alias("n_outliers"))  # q: one row a column
    label = F.array(*(F.lit(names[k]) for k in held))[F.col("c")]
    return q.join(n, "c", "left").select(label.alias("column"), "q1", "q3", "lower", "upper", F.coalesce("n_outliers", F.lit(0)).cast("long").alias("n_outliers"), *(["median"] if median else []))


def iqr_outliers(df: DataFrame, cols, threshold: float = 1.5, samples: int = 5) -> DataFrame:
    """Per numeric column, IQR fences, the TRUE outlier count and the ``samples`` smallest outlying values
    (fixes the reference's cap-at-5 count): two passes for the fences and counts, a third for the examples."""
    cols = list(cols)
    fences = iqr_summary(df, cols, [_num(c) for c in cols], threshold).checkpoint(eager=True)  # one row a column
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _num(c).alias("v")) for c in cols))).alias("x")).select("x.*")
    out = long.join(F.broadcast(fences.select("column", "lower", "upper")), "column").filter((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")))
    w = Window.partitionBy("column").orderBy("v")
    ex = out.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= samples).groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return fences.join(ex, "column", "left").select("column", "q1", "q3", "lower", "upper", "n_outliers", "examples")


def trend_scalars(a: Column, b: Column) -> dict[str, Column]:
    """The aggregates of a linear trend of b on a."""
    both = a.isNotNull() & b.isNotNull()
    return {"slope": F.regr_slope(b, a), "intercept": F.regr_intercept(b, a), "r": pair_corr(a, b), "n": F.count(F.when(both, F.lit(1))),
            "x_min": F.min(F.when(both, a)), "x_max": F.max(F.when(both, a))}


def linear_trend(df: DataFrame, x: str, y: str, points: int = 100, min_pairs: int = 3):
    """OLS slope/intercept, r and n over complete pairs, plus the
    ``points``-point trend line.  Returns (summary_df, line_df)."""
    summ = df.agg(*(v.alias(n) for n, v in trend_scalars(_num(x), _num(y)).items()))
    summ = summ.filter(F.col("n") >= min_pairs)
    line = _trend_line(summ, points)
    return summ, line


def _trend_line(summ: DataFrame, points: int) -> DataFrame:
    """The line is generated from the one summary row (no join); the
    summary columns ride along."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    s = summ.select(i, "slope", "intercept", "r", "n", "x_min", "x_max")
    x = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    return s.select("i", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"),
                    "slope", "intercept", "r", "n")

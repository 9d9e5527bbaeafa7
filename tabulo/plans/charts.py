"""Many charts from two scans (Q04-Q06).

A chart is a small object that says which scalars it needs (``scalars``), which cells (``cells``: key pairs with a value to add
up), and how its tidy rows follow from them (``rows``).  ``draw`` takes any number of charts:

1. the input is written once, pruned to the columns in use (numbers as double, labels as text, dates as timestamps), to
   the shared checkpoint folder;
2. one aggregate gives every scalar of every chart (one row);
3. one aggregate gives every cell: each row emits one (chart, k1, k2, value) for each chart that it counts in, map-side combined,
   so bins, categories, crosstabs, means and rollups of all charts are one shuffle;
4. each chart reads its few cells.

Charts that are rows of the input (bubbles) or need its order (rolling lines) read the pruned input once more.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import qcol
from ..operators import agg as A
from ..operators import series as S
from ..operators import stats as ST
from ..session import ensure_checkpoint_dir

TIDY = "qid int, chart string, series string, x string, y double, x_lo double, x_hi double, extra string"
MIN_VALUES = 3  # fixed value: date and line charts of fewer rows are not drawn


def tidy(df: DataFrame, qid: int, chart: str, series, x, y, extra=None, x_lo=None, x_hi=None) -> DataFrame:
    """One chart's data in the shared tidy shape; numbers rounded to 6 decimals
    (chart precision, identical across engines)."""
    def col(v, t):
        if v is None:
            return F.lit(None).cast(t)
        return (F.col(v) if isinstance(v, str) else v).cast(t)

    return df.select(F.lit(qid).cast("int").alias("qid"), F.lit(chart).alias("chart"),
                     col(series, "string").alias("series"), col(x, "string").alias("x"),
                     F.round(col(y, "double"), 6).alias("y"), F.round(col(x_lo, "double"), 6).alias("x_lo"),
                     F.round(col(x_hi, "double"), 6).alias("x_hi"), col(extra, "string").alias("extra"))


class Data:
    """The pruned input: column names here are n0.. (numbers), t0.. (labels) and d0.. (dates) of the columns asked for."""

    def __init__(self, df: DataFrame):
        self.df, self.used = df, {}

    def _use(self, kind: str, column: str, value: Column) -> Column:
        self.used.setdefault((kind, column), (f"{kind}{len(self.used)}", value))
        return F.col(self.used[kind, column][0])

    def number(self, column: str) -> Column:
        return self._use("n", column, A._num(column))

    def label(self, column: str) -> Column:
        return self._use("t", column, qcol(column).cast("string"))

    def date(self, column: str) -> Column:
        return self._use("d", column, qcol(column).try_cast("timestamp_ntz"))

    def write(self) -> DataFrame:
        spark = self.df.sparkSession
        path = f"{ensure_checkpoint_dir(spark)}/charts-{uuid.uuid4().hex}"
        self.df.select(*(v.alias(n) for n, v in self.used.values())).write.parquet(path)
        return spark.read.parquet(path)


class Chart:
    """Base: a chart without needs and rows."""

    def ask(self, data: Data) -> None:
        """Name the columns that are used."""

    def scalars(self) -> dict[str, Column]:
        return {}

    def cells(self, s) -> Column | None:
        """struct(k1, k2, value) of a row, NULL where it does not count; s: this chart's scalars by name."""
        return None

    def rows(self, qid: int, s, cells: DataFrame | None, base: DataFrame) -> DataFrame | None:
        """Tidy rows from the chart's cells (k1, k2, n rows, m values, total)."""


def cell(holds: Column, k1: Column, k2: Column | None = None, value: Column | None = None) -> Column:
    none = F.lit(None)
    return F.when(holds, F.struct(k1.cast("string").alias("k1"), (none if k2 is None else k2).cast("string").alias("k2"), (none if value is None else value).cast("double").alias("value")))


class Histogram(Chart):
    """Equal-width bins over [min, max]."""

    def __init__(self, column: str, chart: str = "histogram", nbins: int | None = None, min_values: int = 3):
        self.column, self.chart, self.nbins, self.min_values = column, chart, nbins, min_values

    def ask(self, data):
        self.v = data.number(self.column)

    def scalars(self):
        return {"lo": F.min(self.v), "hi": F.max(self.v), "n": F.count(self.v)}

    def _bins(self, s):
        k = self.nbins or A.auto_bins(s["n"])
        return k, float(s["lo"]), float(s["hi"]), (float(s["hi"]) - float(s["lo"])) / k

    def cells(self, s):
        if (s["n"] or 0) < self.min_values:
            return None
        k, lo, _, width = self._bins(s)
        b = F.least(F.floor((self.v - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(k - 1)) if width > 0 else F.lit(0)
        return cell(self.v.isNotNull(), b)

    def rows(self, qid, s, cells, base):
        if cells is None:
            return None
        k, lo, hi, width = self._bins(s)
        bin_ = F.col("bin")
        bins = base.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
        full = bins.join(cells.select(F.col("k1").cast("int").alias("bin"), "n"), "bin", "left")
        return tidy(full.select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(lo) + bin_ * F.lit(width)).alias("lo"),
                                F.when(bin_ == k - 1, F.lit(hi)).otherwise(F.lit(lo) + (bin_ + 1) * F.lit(width)).alias("hi")),
                    qid, self.chart, F.lit(self.column), "bin", "n", x_lo="lo", x_hi="hi")


def top(cells: DataFrame, n: int) -> DataFrame:
    return cells.orderBy(F.desc("n"), F.asc("k1")).limit(n)


class Top(Chart):
    """The n most frequent values."""

    def __init__(self, column: str, n: int):
        self.column, self.n = column, n

    def ask(self, data):
        self.v = data.label(self.column)

    def cells(self, s):
        return cell(self.v.isNotNull(), self.v)

    def rows(self, qid, s, cells, base):
        return tidy(top(cells, self.n), qid, "bar", F.lit(self.column), "k1", "n")


class Shares(Top):
    """The most frequent values as shares of those shown."""

    def rows(self, qid, s, cells, base):
        shown = top(cells, self.n).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # at most n rows
        return tidy(shown, qid, "pie", F.lit(self.column), "k1", "share")


class Cross(Chart):
    """Zero-filled counts of two columns; ``first``: only that many labels of a, in label order."""

    def __init__(self, a: str, b: str, chart: str = "heatmap", first: int | None = None):
        self.a, self.b, self.chart, self.first = a, b, chart, first

    def ask(self, data):
        self.u, self.v = data.label(self.a), data.label(self.b)

    def cells(self, s):
        return cell(self.u.isNotNull() & self.v.isNotNull(), self.u, self.v)

    def rows(self, qid, s, cells, base):
        counts = cells.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "n")
        labels_a = counts.select("a").distinct()
        if self.first:
            labels_a = labels_a.orderBy("a").limit(self.first)
        return tidy(A.zero_filled(counts, labels_a, counts.select("b").distinct()), qid, self.chart, "b", "a", "n")


class TwoWay(Top):
    """A03 without a second column: counts in the crosstab's shape."""

    def __init__(self, column: str, chart: str, n: int = 10):
        super().__init__(column, n)
        self.chart = chart

    def rows(self, qid, s, cells, base):
        return tidy(top(cells, self.n), qid, self.chart, F.lit(None), "k1", "n")


class Means(Chart):
    """Mean of a number by one or two categories."""

    def __init__(self, category: str, number: str, second: str | None = None, named: bool = False):
        self.category, self.number, self.second, self.named = category, number, second, named

    def ask(self, data):
        self.v, self.u = data.number(self.number), data.label(self.category)
        self.w = data.label(self.second) if self.second else None

    def cells(self, s):
        return cell(self.u.isNotNull() & (F.lit(True) if self.w is None else self.w.isNotNull()), self.u, self.w, self.v)

    def rows(self, qid, s, cells, base):
        mean = cells.select("k1", "k2", F.try_divide("total", "m").alias("mean"), "m")
        series = F.lit(self.number) if self.named else "k2"
        return tidy(mean, qid, "bar", series, "k1", "mean", "m")


class Periods(Chart):
    """A10: counts per calendar unit."""

    def __init__(self, column: str):
        self.column = column

    def ask(self, data):
        self.d = data.date(self.column)

    def scalars(self):
        return {"lo": F.min(self.d), "hi": F.max(self.d), "n": F.count(self.d)}

    def cells(self, s):
        if (s["n"] or 0) < MIN_VALUES:
            return None
        self.unit = A.date_unit((s["hi"] - s["lo"]).total_seconds() / 86400.0)
        return cell(self.d.isNotNull(), F.date_trunc(self.unit, self.d).cast("date"))

    def rows(self, qid, s, cells, base):
        return None if cells is None else tidy(cells, qid, "histogram", F.lit(self.unit), "k1", "n")


class Trend(Chart):
    """The line of a linear trend, from scalars alone."""

    def __init__(self, x: str, y: str, series: str = "trend", points: int = 100):
        self.x, self.y, self.series, self.points = x, y, series, points

    def ask(self, data):
        self.u, self.v = data.number(self.x), data.number(self.y)

    def scalars(self):
        return ST.trend_scalars(self.u, self.v)

    def rows(self, qid, s, cells, base):
        if (s["n"] or 0) < 3:
            return None
        summary = base.sparkSession.range(1).select(*(F.lit(s[k]).cast("double" if k != "n" else "long").alias(k) for k in ("slope", "intercept", "r", "n", "x_min", "x_max")))
        return tidy(ST._trend_line(summary, self.points), qid, "scatter", F.lit(self.series), "x", "y")


class Box(Chart):
    """Quartiles, mean and number of outliers; the pruned column is read again for the exact quartiles."""

    def __init__(self, column: str):
        self.column = column

    def ask(self, data):
        self.v = data.number(self.column)

    def scalars(self):
        return {"mean": F.avg(self.v), "n": F.count(self.v), "sketch": ST.column_sketches([self.v], probs=(0.25, 0.5, 0.75))[0]}

    def rows(self, qid, s, cells, base):
        if not s["n"]:
            return None
        b = ST.iqr_summary(base, [self.column], [self.v], row={"_sketch0": s["sketch"]}, median=True)
        values = F.array(*(F.struct(F.lit(n).alias("x"), F.col(c).cast("double").alias("y")) for n, c in (("q1", "q1"), ("median", "median"), ("q3", "q3"), ("n_outliers", "n_outliers"))),
                         F.struct(F.lit("mean").alias("x"), F.lit(s["mean"]).cast("double").alias("y")))
        return tidy(b.select(F.inline(values)), qid, "box", F.lit(self.column), "x", "y")


class Correlations(Chart):
    """One pass over the pruned numbers."""

    def __init__(self, columns):
        self.columns = list(columns)

    def ask(self, data):
        self.v = [data.number(c) for c in self.columns]

    def rows(self, qid, s, cells, base):
        return tidy(ST.correlations(base, self.columns, self.v), qid, "heatmap", "c1", "c2", "r")


class Rollup(Chart):
    """Sums (or counts) at every level of a hierarchy; the leaves are cells, upper levels add them up."""

    def __init__(self, columns, value: str | None):
        self.columns, self.value = list(columns), value

    def ask(self, data):
        self.keys = [data.label(c) for c in self.columns]
        self.v = data.number(self.value) if self.value else None

    def cells(self, s):
        whole = reduce(Column.__and__, (k.isNotNull() for k in self.keys))
        return cell(whole, F.to_json(F.array(*self.keys)), None, self.v)

    def rows(self, qid, s, cells, base):
        names = [f"l{i}" for i in range(len(self.columns))]
        parts = F.from_json("k1", "array<string>")
        leaves = cells.select(*(parts[i].alias(n) for i, n in enumerate(names)), "n", F.when(F.col("m") > 0, F.col("total")).alias("total"))
        value = F.sum("total") if self.value else F.sum("n")
        nodes = leaves.rollup(*names).agg(value.alias("value"))
        level = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
        label = F.concat_ws("/", *(F.coalesce(F.col(n), F.lit("")) for n in names))
        return tidy(nodes.withColumn("level", level), qid, "sunburst", F.col("level").cast("string"), label, "value")


class Flow(Chart):
    """Sums (or counts) between two columns."""

    def __init__(self, source: str, target: str, value: str | None):
        self.source, self.target, self.value = source, target, value

    def ask(self, data):
        self.u, self.w = data.label(self.source), data.label(self.target)
        self.v = data.number(self.value) if self.value else None

    def cells(self, s):
        return cell(self.u.isNotNull() & self.w.isNotNull(), self.u, self.w, self.v)

    def rows(self, qid, s, cells, base):
        value = F.when(F.col("m") > 0, F.col("total")) if self.value else F.col("n")
        return tidy(cells, qid, "sankey", "k1", "k2", value)


class Bubble(Chart):
    """One point a row."""

    def __init__(self, x: str, y: str, size: str | None, colour: str | None):
        self.x, self.y, self.size, self.colour = x, y, size, colour

    def ask(self, data):
        none = F.lit(None)
        self.columns = [data.number(self.x), data.number(self.y), data.number(self.size) if self.size else none, data.label(self.colour) if self.colour else none]

    def rows(self, qid, s, cells, base):
        x, y, size, colour = self.columns
        return tidy(base.filter(x.isNotNull() & y.isNotNull()), qid, "bubble", colour, x, y, size.cast("double").cast("string"))


class Line(Chart):
    """A rolling series; reads the pruned columns in order."""

    def __init__(self, date: str, number: str):
        self.date, self.number = date, number

    def ask(self, data):
        self.d, self.v = data.date(self.date), data.number(self.number)
        data.used["x", self.date] = (f"x{len(data.used)}", qcol(self.date).cast("string"))  # as the column itself reads
        self.shown = data.used["x", self.date][0]

    def scalars(self):
        return {"n": F.count(F.when(self.d.isNotNull() & self.v.isNotNull(), F.lit(1)))}

    def rows(self, qid, s, cells, base):
        if s["n"] < MIN_VALUES:
            return None
        d = base.select(self.d.alias("d"), self.v.alias("v"), F.col(self.shown).alias("shown"))
        r = S.rolling(d, "d", "v", tiebreak=["shown"])
        return tidy(r, qid, "line", F.lit("rolling_mean"), "shown", "rolling_mean", x_lo="band_min", x_hi="band_max")


def draw(df: DataFrame, charts) -> DataFrame:
    """The tidy rows of all charts (qid, chart): two scans of the pruned input for all scalars and cells."""
    spark = df.sparkSession
    charts = list(charts)
    data = Data(df)
    for _, chart in charts:
        chart.ask(data)
    if not data.used:
        return spark.createDataFrame([], TIDY)
    base = data.write()
    wanted = {f"s{i}_{n}": v for i, (_, chart) in enumerate(charts) for n, v in chart.scalars().items()}
    row = base.agg(*(v.alias(n) for n, v in wanted.items())).first() if wanted else {}
    found = [{n: row[f"s{i}_{n}"] for n in chart.scalars()} for i, (_, chart) in enumerate(charts)]
    asked = [(i, c) for i, (_, chart) in enumerate(charts) if (c := chart.cells(found[i])) is not None]
    cells = None
    if asked:
        each = F.array(*(F.when(c.isNotNull(), F.struct(F.lit(i).alias("chart"), c.alias("c"))) for i, c in asked))
        long = base.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.chart", "x.c.*")
        cells = long.groupBy("chart", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("m"), F.sum("value").alias("total")).checkpoint(eager=True)
    has = {i for i, _ in asked}
    parts = [chart.rows(qid, found[i], cells.filter(F.col("chart") == i) if i in has else None, base) for i, (qid, chart) in enumerate(charts)]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TIDY)

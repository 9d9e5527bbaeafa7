"""Chart aggregates (A01-A10, A15-A18) as DataFrame operators.

Every operator returns the *data behind a chart* as a small tidy DataFrame and
computes it on all rows (deviation D7: the reference samples above 120,000
rows).  All group-bys run with partial (map-side) aggregation, so a key that
holds a third of the rows is reduced inside each map task before the
exchange.  NULL keys are removed, as pandas ``groupby`` does.  Ties are
broken by the label, ascending (D9).
"""

from __future__ import annotations

import math

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import qcol


#: a crosstab's labels are paired in LABEL_BLOCKS x LABEL_BLOCKS blocks
LABEL_BLOCKS = 16


def _q(c: str):
    return qcol(c)


def _num(c: str):
    v = _q(c).cast("double")
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


# ---------------------------------------------------------------- A01 / A02
def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent non-null values -> (value, n, rank)."""
    counts = df.filter(_q(col).isNotNull()).groupBy(_q(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), F.asc("value"))
    # global top-k over already-aggregated counts (one row per distinct value)
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(n).withColumn(
        "rank", F.row_number().over(w).cast("long"))


def value_shares(df: DataFrame, col: str, n: int = 8) -> DataFrame:
    """Top-n slices with their share of the shown slices and of all rows."""
    top = top_values(df, col, n)
    total = df.filter(_q(col).isNotNull()).count()  # scalar
    w = Window.partitionBy()  # over the <= n kept slices only
    return (
        top.withColumn("share", F.col("n") / F.sum("n").over(w))
        .withColumn("share_of_all", F.col("n") / F.lit(max(total, 1)))
    )


# ---------------------------------------------------------------- A03 / A04
def second_dimension(prof_rows, col: str, lo: int, hi: int, exclude=()):
    """First other categorical column (schema order) with lo <= distinct <= hi."""
    for r in sorted(prof_rows, key=lambda r: r["ordinal"]):
        if r["column"] == col or r["column"] in exclude:
            continue
        if r["role"] in ("cat",) and lo <= r["nunique"] <= hi:
            return r["column"]
    return None


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.filter(_q(a).isNotNull() & _q(b).isNotNull())
        .groupBy(_q(a).cast("string").alias("a"), _q(b).cast("string").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def crosstab(df: DataFrame, a: str, b: str, a_labels=None, b_labels=None) -> DataFrame:
    """Zero-filled crosstab in long form (a, b, n).

    The labels stay tables: each is dealt to one of LABEL_BLOCKS rows or columns of blocks, and a block
    pairs its ``a`` and ``b`` labels; labels are values, never SQL text or column names."""
    counts = pair_counts(df, a, b)
    if b_labels is None:
        of_b = counts.select("b").distinct()
    elif not b_labels:
        return counts.limit(0)
    else:
        labels = F.from_json(F.lit(json.dumps([str(v) for v in b_labels])), "array<string>")  # the caller's own
        of_b = df.sparkSession.range(1).select(F.explode(labels).alias("b"))
    if a_labels is not None:
        counts = counts.filter(F.col("a").isin(a_labels))

    return zero_filled(counts, counts.select("a").distinct(), of_b)


def zero_filled(counts: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
    """(a, b, n) for every label of a with every label of b, 0 where counts (a, b, n) has no row.  The result is as large as the
    product of the labels: that is what a zero-filled crosstab is."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(LABEL_BLOCKS))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LABEL_BLOCKS - 1).cast("long")))
    of_a = of_a.select("a", block("a").alias("_i"), every.alias("_j"))
    of_b = of_b.select("b", block("b").alias("_j"), every.alias("_i"))
    labels = of_a.join(of_b, ["_i", "_j"]).select("a", "b")
    return labels.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def two_way_auto(df: DataFrame, col: str, prof_rows, top_n: int = 10) -> DataFrame:
    """Counts of ``col``, crossed with the first other category of 2-5
    labels when one exists; the first ``top_n`` labels in label order."""
    second = second_dimension(prof_rows, col, 2, 5)
    if second is None:
        return top_values(df, col, top_n).select(
            F.col("value").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    counts = pair_counts(df, col, second)
    first_labels = counts.select("a").distinct().orderBy("a").limit(top_n)
    b_labels = [r[0] for r in counts.select("b").distinct().orderBy("b").collect()]
    ct = crosstab(df, col, second, b_labels=b_labels)
    return ct.join(F.broadcast(first_labels), "a")  # <= top_n rows


# ---------------------------------------------------------------- A05 - A07
def _mean_aggs(measure: str, decimals: int | None):
    """avg as double, or -- for money -- an exact DECIMAL sum divided once."""
    if decimals is None:
        return [F.avg(_num(measure)).alias("mean"), F.count(_num(measure)).alias("n")]
    v = _q(measure).cast(f"decimal(38,{decimals})")
    return [(F.sum(v).cast("double") / F.count(v)).alias("mean"), F.count(v).alias("n")]


def mean_by_category(df: DataFrame, cat: str, measure: str, decimals: int | None = None) -> DataFrame:
    """Mean (and count) of a measure per category, sorted desc."""
    g = df.filter(_q(cat).isNotNull()).groupBy(_q(cat).alias(cat)).agg(*_mean_aggs(measure, decimals))
    return g.orderBy(F.desc_nulls_last("mean"), F.asc(cat))


def ranked(means: DataFrame, value: str, label: str) -> DataFrame:
    """``rank`` from 1, highest value first (NULL last), ties by label; the dense index of ``series``, so no task sorts all labels."""
    from .series import global_index

    keyed = means.withColumn("_none", _q(value).isNull()).withColumn("_down", -_q(value))
    return global_index(keyed, ["_none", "_down", label]).withColumn("rank", F.col("_idx") + 1).drop("_none", "_down", "_idx")


def mean_by_two(df: DataFrame, cat: str, measure: str, second: str | None = None, prof_rows=None,
                decimals: int | None = None) -> DataFrame:
    """Mean by two categories; 2nd one chosen as first other category with 2-7 labels."""
    if second is None and prof_rows is not None:
        second = second_dimension(prof_rows, cat, 2, 7)
    if second is None:
        return mean_by_category(df, cat, measure, decimals).withColumn("second", F.lit(None).cast("string"))
    return (
        df.filter(_q(cat).isNotNull() & _q(second).isNotNull())
        .groupBy(_q(cat).alias(cat), _q(second).cast("string").alias("second"))
        .agg(*_mean_aggs(measure, decimals))
    )


def mean_scaled(means: DataFrame, col: str = "mean") -> DataFrame:
    """Min-max scaling of group means (0.5 when all equal). Input is one
    row per group (already aggregated)."""
    w = Window.partitionBy()
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return means.withColumn("scaled", F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.5)))


# ---------------------------------------------------------------- A08 - A10
def auto_bins(n: int) -> int:
    """min(40, max(10, int(sqrt(n))))."""
    return min(40, max(10, int(math.sqrt(n))))


def histogram(df: DataFrame, col: str, nbins: int | None = None, min_values: int = 3) -> DataFrame:
    """Equal-width bins over [min, max]; the max value falls in the
    last bin (D6).  Two passes: a one-row min/max/count aggregate, then one
    grouped count.  All bins are returned, empty ones with n = 0."""
    v = _num(col)
    st = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, n long"
    if st["n"] is None or st["n"] < min_values:
        return spark.createDataFrame([], schema)
    k = nbins or auto_bins(st["n"])
    lo, hi = float(st["lo"]), float(st["hi"])
    width = (hi - lo) / k
    if width > 0:
        b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(k - 1))
    else:
        b = F.lit(0)
    counts = df.filter(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    return (
        bins.join(counts, "bin", "left")
        .select("bin",
                (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                F.when(F.col("bin") == k - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def date_unit(span_days: float) -> str:
    if span_days <= 62:
        return "day"
    if span_days <= 1096:
        return "month"
    return "year"


def date_histogram(df: DataFrame, col: str, unit: str | None = None) -> DataFrame:
    """A10: counts per calendar unit (day/month/year chosen from the range)."""
    ts = _q(col).cast("timestamp_ntz")
    if unit is None:
        st = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        if st["lo"] is None:
            unit = "day"
        else:
            unit = date_unit((st["hi"] - st["lo"]).total_seconds() / 86400.0)
    return (
        df.filter(ts.isNotNull())
        .groupBy(F.date_trunc(unit, ts).cast("date").alias("period"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("unit", F.lit(unit))
    )


# ---------------------------------------------------------------- A15 - A18
def hierarchy_rollup(df: DataFrame, cols, value: str | None = None) -> DataFrame:
    """Sum (or count) and row count at every level of a 2-3 level hierarchy.

    Rows with a NULL in any level are removed first (pandas drops them);
    ``rollup`` then yields every node, ``level`` = number of defined keys.
    """
    keys = [_q(c).cast("string").alias(c) for c in cols]
    base = df
    for c in cols:
        base = base.filter(_q(c).isNotNull())
    agg = (F.sum(_num(value)) if value else F.count(F.lit(1)).cast("double")).alias("value")
    out = base.rollup(*keys).agg(agg, F.count(F.lit(1)).alias("n_rows"), F.grouping_id().alias("_gid"))
    level = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    # with NULL keys removed, a NULL key in the output means "rolled up"
    return out.withColumn("level", level).drop("_gid")


def flow_edges(df: DataFrame, source: str, target: str, value: str | None = None) -> DataFrame:
    """Edges (source -> target) with counts or sums, plus node ids keyed by side."""
    agg = (F.sum(_num(value)) if value else F.count(F.lit(1)).cast("double")).alias("value")
    edges = (
        df.filter(_q(source).isNotNull() & _q(target).isNotNull())
        .groupBy(_q(source).cast("string").alias("source"), _q(target).cast("string").alias("target"))
        .agg(agg)
    )
    nodes = (
        edges.select(F.lit(0).alias("side"), F.col("source").alias("label"))
        .union(edges.select(F.lit(1).alias("side"), F.col("target").alias("label")))
        .distinct()
    )
    # node ids: dense index over (side, label) on the distinct labels, computed
    # with the distributed index (no single-task window over all labels)
    from .series import global_index

    nodes = global_index(nodes, ["side", "label"]).withColumnRenamed("_idx", "node_id")
    src = nodes.filter("side = 0").select(F.col("label").alias("source"), F.col("node_id").alias("source_id"))
    dst = nodes.filter("side = 1").select(F.col("label").alias("target"), F.col("node_id").alias("target_id"))
    return edges.join(src, "source").join(dst, "target").select(
        "source", "target", "source_id", "target_id", "value")


SAMPLE_BUCKETS = 65_536


def bounded_sample(df: DataFrame, n: int = 120_000, key_cols=None, seed: int = 42) -> DataFrame:
    """Deterministic sample of exactly min(n, rows) rows, for point clouds only (aggregates use all rows, D7).

    Rows are ordered by an MD5 of the seed and their key columns (all by default).  One pass counts the first
    16 bits of it; every row below the bucket that holds the n-th row stays, and only that bucket is sorted."""
    names = key_cols or df.columns
    parts = [F.coalesce(_q(c).cast("string"), F.lit("\0")) for c in names]
    spot = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    hashed = df.withColumn("_spot", spot).withColumn("_bucket", F.conv(F.substring("_spot", 1, 4), 16, 10).cast("int"))
    left, at = n, SAMPLE_BUCKETS
    for r in hashed.groupBy("_bucket").count().orderBy("_bucket").collect():  # SAMPLE_BUCKETS rows at most
        if r["count"] > left:
            at = r["_bucket"]
            break
        left -= r["count"]
    below, edge = hashed.filter(F.col("_bucket") < at), hashed.filter(F.col("_bucket") == at).orderBy("_spot").limit(left)
    return below.unionByName(edge).drop("_spot", "_bucket")


def bubble_projection(df: DataFrame, x: str, y: str, size: str | None = None, colour: str | None = None) -> DataFrame:
    """X, y, size, colour for a bubble chart; rows missing x or y dropped, all others kept."""
    cols = [_num(x).alias("x"), _num(y).alias("y"),
            (_num(size) if size else F.lit(None).cast("double")).alias("size"),
            (_q(colour).cast("string") if colour else F.lit(None).cast("string")).alias("colour")]
    return df.select(*cols).na.drop(subset=["x", "y"])

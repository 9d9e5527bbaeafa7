"""Report tables (A19-A23): cleaning report, anomaly log, header, summary.

All inputs are either whole-table aggregates (one pass each) or the profile
(one row per column); outputs are ordinary small DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import qcol
from ..operators.clean import cleaner_for, rename_map
from ..operators.freq import freq
from ..operators.profile import dataset_summary
from ..operators.stats import column_sketches, iqr_summary


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and null cells before/after cleaning and % null reduction."""
    b = dataset_summary(before).select(F.col("rows").alias("rows_before"), F.col("null_cells").alias("nulls_before"))
    a = dataset_summary(after).select(F.col("rows").alias("rows_after"), F.col("null_cells").alias("nulls_after"))
    # two one-row aggregates side by side (union + max, no join needed)
    j = b.unionByName(a, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("rows_before", "nulls_before", "rows_after", "nulls_after")])
    return j.withColumn("null_reduction_pct", F.round(
        100.0 * (F.col("nulls_before") - F.col("nulls_after")) / F.greatest(F.col("nulls_before"), F.lit(1)), 2))


def anomaly_log(raw: DataFrame, prof_rows, outlier_threshold: float = 1.5) -> DataFrame:
    """Per cleaned column, (column, problem, n):

    * ``number_lost`` / ``date_lost`` -- non-null raw values that became NULL,
    * ``distinct_before`` / ``distinct_after`` -- for normalised categories,
    * ``outliers`` -- true IQR outlier count of number columns.

    Three passes at most: one row of loss counts and quartile sketches, the bracket counts of all numbers, and the
    distinct keys of raw and cleaned categories.  Column names are values, never SQL."""
    spark = raw.sparkSession
    names = rename_map(prof_rows)
    named = lambda r: names.get(r["column"], r["column"])
    typed = [r for r in sorted(prof_rows, key=lambda r: r["ordinal"]) if r["data_type"] in ("number", "date", "category")]
    clean = {r["column"]: cleaner_for(r["data_type"], r["family"], r["column"]) for r in typed}
    conv = [r for r in typed if r["data_type"] in ("number", "date")]
    nums = [r for r in typed if r["data_type"] == "number"]
    cats = [r for r in typed if r["data_type"] == "category"]
    parts, found = [], []
    if conv:
        lost = [F.count(F.when(qcol(r["column"]).isNotNull() & clean[r["column"]].isNull(), F.lit(1))).alias(f"_lost{i}") for i, r in enumerate(conv)]
        values = [clean[r["column"]].cast("double") for r in nums]
        row = raw.agg(*lost, *column_sketches(values)).first()
        found += [(named(r), f"{r['data_type']}_lost", row[f"_lost{i}"]) for i, r in enumerate(conv)]
        if nums:
            o = iqr_summary(raw, [named(r) for r in nums], values, outlier_threshold, row=row)
            parts.append(o.filter(F.col("n_outliers") > 0).select("column", F.lit("outliers").alias("problem"), F.col("n_outliers").alias("n")))
    if cats:
        both = [qcol(r["column"]).alias(f"b{i}") for i, r in enumerate(cats)] + [clean[r["column"]].alias(f"a{i}") for i, r in enumerate(cats)]
        per = freq(raw.select(*both)).groupBy("ordinal").agg(F.count("key").alias("n"))
        label = lambda xs: F.array(*(F.lit(x) for x in xs))[F.col("ordinal")]
        k = len(cats)
        parts.append(per.select(label([named(r) for r in cats] * 2).alias("column"), label(["distinct_before"] * k + ["distinct_after"] * k).alias("problem"), "n"))
    parts.insert(0, spark.createDataFrame(found, "column string, problem string, n long"))
    return reduce(DataFrame.unionByName, [p.select("column", "problem", F.col("n").cast("long")) for p in parts])


def report_header(prof: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Rows, columns, anomaly count, mean confidence (%), quality = 0.95 x mean."""
    p = prof.agg(F.max("n_rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
                 F.avg("confidence").alias("mean_conf"))
    a = anomalies.agg(F.count(F.lit(1)).alias("anomalies"))
    return p.unionByName(a, allowMissingColumns=True).agg(
        F.max("rows").cast("long").alias("rows"), F.max("columns").cast("long").alias("columns"),
        F.max("anomalies").cast("long").alias("anomalies"),
        F.round(100.0 * F.max("mean_conf"), 1).alias("mean_confidence_pct"),
        F.round(95.0 * F.max("mean_conf"), 1).alias("quality_pct"))


def proposals_summary(prof: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Column count, mean confidence, number of distinct types, anomalies per column."""
    s = prof.agg(F.count(F.lit(1)).alias("columns"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
                 F.count_distinct("data_type").alias("distinct_types"))
    if anomalies is None:
        return s
    per = anomalies.groupBy("column").agg(F.count(F.lit(1)).alias("anomalies"))
    return s.unionByName(per.agg(F.round(F.avg("anomalies"), 4).alias("anomalies_per_column")),
                         allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in
                                                         ("columns", "mean_confidence", "distinct_types",
                                                          "anomalies_per_column")])


def missing_cells_pct(df: DataFrame) -> DataFrame:
    """100 * null cells / (rows x columns), rounded to 2."""
    s = dataset_summary(df)
    return s.select("rows", "columns", "null_cells", F.round(
        100.0 * F.col("null_cells") / F.greatest(F.col("rows") * F.col("columns"), F.lit(1)), 2).alias("missing_pct"))

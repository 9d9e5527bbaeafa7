"""Data-confidence scoring (K01-K06) over the profile DataFrame.

The profile already holds, per column, the counts (from the frequency
table) and mean / sample std (one aggregate pass), so every score here is
arithmetic on one-row-per-column data.  Question scores explode the
question's column list and join the column scores (broadcast: one row per
column of the table).

Deviation (F16): an all-null or single-valued numeric column has no
coefficient of variation; it gets the 0.3 fallback instead of the
reference's NaN-driven 1.0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score thresholds and the 5-cell bar.
LABEL_STEPS = [(0.85, "excellent", "high confidence, reliable results"),
               (0.70, "good", "usable results"),
               (0.55, "medium", "to be validated, partial data"),
               (0.40, "weak", "caution, incomplete data")]
LOWEST_LABEL = ("very weak", "not recommended, too much missing data")
BAR_STEPS = [(0.85, "█████"), (0.70, "████░"), (0.55, "███░░")]
LOWEST_BAR = "██░░░"


def label(score) -> F.Column:
    out = None
    for t, name, _ in LABEL_STEPS:
        out = F.when(score >= t, F.lit(name)) if out is None else out.when(score >= t, F.lit(name))
    return out.otherwise(F.lit(LOWEST_LABEL[0]))


def advice(score) -> F.Column:
    out = None
    for t, _, text in LABEL_STEPS:
        out = F.when(score >= t, F.lit(text)) if out is None else out.when(score >= t, F.lit(text))
    return out.otherwise(F.lit(LOWEST_LABEL[1]))


def bar(score) -> F.Column:
    out = None
    for t, b in BAR_STEPS:
        out = F.when(score >= t, F.lit(b)) if out is None else out.when(score >= t, F.lit(b))
    return out.otherwise(F.lit(LOWEST_BAR))


def _is_text(p=None) -> F.Column:
    return F.col("family") == "string"


def column_confidence(prof: DataFrame) -> DataFrame:
    """K01 + K05: one row per column with confidence, bar, completeness,
    distinct count and source type."""
    n = F.col("n_rows")
    completeness = F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.col("nulls") / n)).otherwise(F.lit(0.0))
    text_var = F.least(F.lit(1.0), F.col("nunique") / F.greatest(F.lit(1.0), n * 0.1)) * 0.5
    cv = F.try_divide(F.col("std"), F.abs(F.col("mean")))
    num_var = F.when(cv.isNull(), F.lit(0.3)).otherwise(F.least(cv, F.lit(2.0)) / 2 * 0.5)
    variability = F.when(_is_text(), text_var).otherwise(num_var)
    conf = F.least(F.lit(1.0), completeness * 0.5 + variability)
    # question-level variability (K02): text distinct/n, numeric min(1, sd/(mean+1e-6))
    q_var = F.when(_is_text(), F.try_divide(F.col("nunique"), n)).otherwise(
        F.least(F.lit(1.0), F.try_divide(F.col("std"), F.col("mean") + 1e-6)))
    return prof.select(
        "ordinal", "column", "source_type",
        conf.alias("confidence_raw"),
        F.round(conf, 2).alias("confidence"),
        bar(conf).alias("bar"),
        completeness.alias("completeness_raw"),
        F.round(completeness, 2).alias("completeness"),
        F.col("nunique").alias("unique_values"),
        q_var.alias("q_variability"),
    )


def question_confidence(questions: DataFrame, col_conf: DataFrame, qid: str = "qid",
                        columns: str = "columns") -> DataFrame:
    """Per question, mean column confidence + arity bonus (0 / +0.05
    / -0.10 for 1 / 2 / 3+ found columns), capped at 1; mean completeness and
    variability; found and missing columns; quality label and advice."""
    q = questions.select(F.col(qid).alias("qid"), F.col(columns).alias("columns"))
    cc = col_conf.select(F.col("column").alias("col"), "confidence_raw", "completeness_raw", "q_variability")
    exploded = q.select("qid", "columns", F.posexplode_outer("columns").alias("pos", "col"))
    j = exploded.join(F.broadcast(cc), "col", "left")  # one row per table column
    found = F.col("confidence_raw").isNotNull()
    g = j.groupBy("qid").agg(
        F.first("columns").alias("columns"),
        F.count(F.when(found, F.lit(1))).alias("n_found"),
        F.avg(F.when(found, F.col("confidence_raw"))).alias("mean_conf"),
        F.avg(F.when(found, F.col("completeness_raw"))).alias("completeness_raw"),
        F.avg(F.when(found, F.col("q_variability"))).alias("variability_raw"),
        F.array_sort(F.collect_list(F.when(found, F.struct("pos", "col")))).alias("_f"),
        F.array_sort(F.collect_list(F.when(~found & F.col("col").isNotNull(), F.struct("pos", "col")))).alias("_m"),
    )
    bonus = F.when(F.col("n_found") == 1, 0.0).when(F.col("n_found") == 2, 0.05).otherwise(-0.10)
    overall = F.when(F.col("n_found") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.col("mean_conf") + bonus))
    no_cols = F.coalesce(F.size("columns"), F.lit(0)) == 0
    return g.select(
        "qid",
        F.round(overall, 2).alias("overall"),
        overall.alias("overall_raw"),
        F.coalesce("completeness_raw", F.lit(0.0)).alias("completeness_raw"),
        F.coalesce("variability_raw", F.lit(0.0)).alias("variability_raw"),
        F.round(F.coalesce("completeness_raw", F.lit(0.0)), 2).alias("completeness"),
        F.round(F.coalesce("variability_raw", F.lit(0.0)), 2).alias("variability"),
        F.when(no_cols, F.lit("no column")).when(F.col("n_found") == 0, F.lit("columns not found"))
        .otherwise(label(overall)).alias("data_quality"),
        F.when(no_cols, F.lit("select valid columns"))
        .when(F.col("n_found") == 0, F.lit("the columns are not in the table"))
        .otherwise(advice(overall)).alias("recommendation"),
        F.transform("_f", lambda x: x["col"]).alias("columns_checked"),
        F.transform("_m", lambda x: x["col"]).alias("columns_missing"),
    )


def table_confidence(col_conf: DataFrame) -> DataFrame:
    """Mean of the (rounded) column scores, bar and quality summary."""
    g = col_conf.agg(F.avg("confidence").alias("s"), F.avg("confidence_raw").alias("s_raw"),
                     F.count(F.lit(1)).alias("n_columns"))
    s = F.coalesce(F.col("s"), F.lit(0.0))
    return g.select(
        F.round(s, 2).alias("global_confidence"), bar(s).alias("global_bar"),
        F.col("s_raw").alias("global_confidence_raw"),
        F.when(s >= 0.85, F.lit("excellent")).when(s >= 0.70, F.lit("good")).otherwise(F.lit("medium")).alias(
            "quality_summary"),
        "n_columns",
    )

"""Column profiling and type inference.

``profile(df)`` returns ONE ROW PER COLUMN, computed from two distributed
passes:

* the frequency table P00 (keys of values, one shuffle, map-side combined),
  aggregated per column: rows, nulls, exact distinct count, number/date shape
  ratios and the keys of the 5 most frequent values (``row_number`` <= 5 per
  column, which Spark plans as a per-partition group limit before the
  exchange), whose texts are looked up last;
* one global aggregate over the numeric columns (mean, sample std, min,
  max, integral test) -- partial aggregation only, no data shuffle.

The result is as small as the schema is wide; it is the only thing the
planning code ever collects.  Type ratios use the whole column rather than
the first 10/20 rows (deviation D1): there is no row order in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..functions import names as N
from ..functions.text import qcol
from ..functions.numbers import NUM_RE
from .freq import DATE_SHAPE_RE, freq, profilable, type_family, value_text, values_of

GUESS_DATE_RE = r"^(\d{1,4}[-/. ]\d{1,2}[-/. ]\d{1,4})$"
GUESS_ISO_RE = r"^(\d{4}-\d{2}-\d{2})"
N_SAMPLES = 5


def catalog(df: DataFrame, cols=None) -> DataFrame:
    """Schema as a small DataFrame (metadata, not data)."""
    spark = df.sparkSession
    cols = profilable(df, cols)
    rows = [(i, c, type_family(df.schema[c].dataType), df.schema[c].dataType.simpleString())
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "ordinal int, column string, family string, source_type string")


def numeric_stats(df: DataFrame, cols=None) -> DataFrame:
    """(ordinal, mean, std, min, max, is_integral) for numeric, boolean and
    temporal (epoch seconds) columns, one pass."""
    cols = profilable(df, cols)
    num = [(i, c) for i, c in enumerate(cols) if type_family(df.schema[c].dataType) != "string"]
    schema = "ordinal int, mean double, std double, min double, max double, is_integral boolean"
    if not num:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, c in num:
        if type_family(df.schema[c].dataType) == "temporal":
            # epoch seconds: the coefficient of variation does not depend on the unit
            v = F.unix_micros(qcol(c).cast("timestamp")) / F.lit(1e6)
        else:
            v = qcol(c).cast("double")
        v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        aggs += [
            F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
            F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
            F.bool_and(v == F.floor(v)).alias(f"int{i}"),
        ]
    wide = df.agg(*aggs)
    stacked = ", ".join(f"{i}, m{i}, s{i}, lo{i}, hi{i}, int{i}" for i, _ in num)
    return wide.selectExpr(
        f"stack({len(num)}, {stacked}) as (ordinal, mean, std, min, max, is_integral)"
    ).selectExpr(
        "cast(ordinal as int) ordinal", "mean", "std", "min", "max", "is_integral")


def column_counts(ft: DataFrame) -> DataFrame:
    held = F.col("key").isNotNull()
    sum_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return ft.groupBy("ordinal").agg(
        F.sum("n").alias("n_rows"), sum_of(held).alias("non_null"), sum_of(~held).alias("nulls"), F.count("key").alias("nunique"),
        sum_of(F.col("is_num")).alias("num_hits"), sum_of(F.col("is_date")).alias("date_hits"))


def top_keys(ft: DataFrame, k: int = N_SAMPLES) -> DataFrame:
    """(ordinal, key, rk): the k most frequent non-null values per column, ties by key (deterministic).

    NULL is ranked last inside the window instead of being filtered first,
    so this branch shares the frequency-table exchange with
    ``column_counts`` (Spark reuses it; a pushed-down filter would not)."""
    w = Window.partitionBy("ordinal").orderBy(F.col("key").isNull().asc(), F.desc("n"), F.asc("key"))
    return ft.select("ordinal", "key", "n", F.row_number().over(w).alias("rk")).filter((F.col("rk") <= k) & F.col("key").isNotNull())


def samples_of(df: DataFrame, ft: DataFrame, cols, k: int = N_SAMPLES) -> DataFrame:
    """(ordinal, samples): the texts of the k most frequent values of each column."""
    top = top_keys(ft, k).select("ordinal", "key", "rk")
    named = values_of(df, top, cols).join(F.broadcast(top), ["ordinal", "key"])  # k rows a column
    return named.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("rk", "value"))).alias("_s")).select(
        "ordinal", F.transform("_s", lambda x: x["value"]).alias("samples"))


def _guess_type(p) -> F.Column:
    """Keyword + sample guess (reported beside the data-driven type)."""
    name = F.lower(F.col("column"))
    samples = F.coalesce(F.col("samples"), F.array().cast("array<string>"))
    k = F.size(samples)
    date_like = F.size(F.filter(samples, lambda x: (
        x.rlike(r"[/\-. ]") & (F.length(x) >= 4) & (F.length(x) <= 19)
        & (x.rlike(GUESS_DATE_RE) | x.rlike(GUESS_ISO_RE)))))
    skip5 = (F.col("family") == "string")
    num_like = F.size(F.filter(samples, lambda x: x.rlike(NUM_RE) & ~(skip5 & x.rlike(r"^\d{5}$"))))
    num_like = F.when(F.col("family") == "numeric", k).otherwise(num_like)
    return (
        F.when((F.instr(name, "code postal") > 0) | (F.instr(name, "postal code") > 0)
               | (F.trim(name) == "cp"), F.lit("category"))
        .when(N.contains_any(name, N.GUESS_DATE_WORDS), F.lit("date"))
        .when((k > 0) & (date_like >= k * 0.6), F.lit("date"))
        .when((k > 0) & (num_like >= k * 0.8), F.lit("number"))
        .when(N.contains_any(name, N.GUESS_ID_WORDS), F.lit("id"))
        .when(N.contains_any(name, N.GUESS_NUMBER_WORDS), F.lit("number"))
        .when(F.col("nunique") < 15, F.lit("category"))
        .otherwise(F.lit("text"))
    )


def _verified_type() -> F.Column:
    """P02 + P03: id -> number -> date -> category -> text."""
    name = F.lower(F.col("column"))
    nn = F.col("non_null")
    is_id = N.contains_any(name, N.ID_NAME_WORDS) & (F.col("nunique") >= nn * 0.95)
    fam = F.col("family")
    is_number = (nn > 0) & ((fam == "numeric") | ((fam == "string") & (F.col("num_hits") >= nn * 0.9)))
    is_date = (nn > 0) & ((fam == "temporal") | ((fam == "string") & (F.col("date_hits") >= nn * 0.7)))
    return (
        F.when(is_id, F.lit("id"))
        .when(is_number, F.lit("number"))
        .when(is_date, F.lit("date"))
        .when((F.col("nunique") > 1) & (F.col("nunique") < 20), F.lit("category"))
        .otherwise(F.lit("text"))
    )


def near_unique_split(df: DataFrame, cols, ratio: float = 0.5, rsd: float = 0.02):
    """One aggregate pass: per column non-null count, approximate distinct
    count and the number/date shape hit counts.  Returns (stats_rows,
    near_unique_columns) -- the stats are one row per column."""
    aggs = []
    for i, c in enumerate(cols):
        raw = qcol(c)
        v = value_text(df, c)
        aggs += [F.count(v).alias(f"nn{i}"), F.approx_count_distinct(raw, rsd).alias(f"nd{i}")]
        if type_family(df.schema[c].dataType) == "string":  # shape ratios only matter for text
            aggs += [F.count(F.when(raw.try_cast("double").isNotNull() & raw.rlike(NUM_RE), 1)).alias(f"nh{i}"),
                     F.count(F.when((F.length(raw) <= 10) & raw.rlike(DATE_SHAPE_RE), 1)).alias(f"dh{i}")]
        else:
            aggs += [F.lit(0).alias(f"nh{i}"), F.lit(0).alias(f"dh{i}")]
    r = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    stats = {c: dict(n_rows=r["_rows"], non_null=r[f"nn{i}"], nunique=r[f"nd{i}"], num_hits=r[f"nh{i}"],
                     date_hits=r[f"dh{i}"]) for i, c in enumerate(cols)}
    near = [c for c in cols if stats[c]["non_null"] > 0 and stats[c]["nunique"] >= ratio * stats[c]["non_null"]]
    return stats, near


def profile(df: DataFrame, cols=None, ft: DataFrame | None = None, exact_distinct: bool = True,
            near_unique_ratio: float = 0.5) -> DataFrame:
    """One row per column: counts, samples, verified/guessed type, roles.

    ``exact_distinct=False`` (for very large tables): near-unique columns
    (approximate distinct >= ``near_unique_ratio`` x non-null) are kept out
    of the frequency table, which would otherwise be as large as the data;
    their distinct count is the HyperLogLog++ estimate (2% rsd, flagged by
    ``nunique_exact = false``) and their samples are the 5 smallest values
    (a bounded top-k).  Thresholds on the distinct ratio (0.95, 0.98,
    0.995) are then decided on the estimate."""
    cols = profilable(df, cols)
    near, approx_rows = [], None
    if not exact_distinct and ft is None:
        stats, near = near_unique_split(df, cols, near_unique_ratio)
        if near:
            spark = df.sparkSession
            ords = {c: i for i, c in enumerate(cols)}
            samples = {}
            for c in near:
                v = value_text(df, c)
                samples[c] = [x[0] for x in df.select(v.alias("v")).filter(F.col("v").isNotNull())
                              .orderBy("v").limit(N_SAMPLES).collect()]
            approx_rows = spark.createDataFrame(
                [(ords[c], stats[c]["n_rows"], stats[c]["non_null"], stats[c]["n_rows"] - stats[c]["non_null"],
                  stats[c]["nunique"], stats[c]["num_hits"], stats[c]["date_hits"], samples[c]) for c in near],
                "ordinal int, n_rows long, non_null long, nulls long, nunique long, num_hits long, "
                "date_hits long, samples array<string>")
    exact_cols = [c for c in cols if c not in near]
    cat = catalog(df, cols)
    parts = None
    if exact_cols:
        ft = ft if ft is not None else freq(df, exact_cols)
        parts = column_counts(ft).join(samples_of(df, ft, exact_cols), "ordinal", "left")
        if exact_cols != cols:  # re-number the frequency table's ordinals to the full schema
            parts = parts.withColumn("ordinal", F.array(*(F.lit(cols.index(c)) for c in exact_cols))[F.col("ordinal")])
    if approx_rows is not None:
        parts = approx_rows if parts is None else parts.unionByName(approx_rows)
    if parts is None:  # nothing profilable (only nested / binary columns)
        parts = df.sparkSession.createDataFrame(
            [], "ordinal int, n_rows long, non_null long, nulls long, nunique long, num_hits long, date_hits long, "
                "samples array<string>")
    exact_flag = F.lit(True) if not near else ~F.col("column").isin(*near)
    # all joined sides are one row per column: size bounded by the schema width
    p = (
        cat.join(F.broadcast(parts), "ordinal", "left")
        .join(F.broadcast(numeric_stats(df, cols)), "ordinal", "left")
        .withColumn("nunique_exact", exact_flag)
    )
    # one projection for the per-column facts, one for the roles (each
    # withColumn would re-analyse the whole plan)
    counts = ["non_null", "nulls", "nunique", "num_hits", "date_hits"]
    p = p.select(*[c for c in p.columns if c not in counts + ["n_rows"]],
                 F.coalesce(F.max(F.col("n_rows")).over(Window.partitionBy()), F.lit(0)).cast("long").alias("n_rows"),
                 *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts])
    p = p.select(
        "*",
        F.round(100.0 * F.col("nulls") / F.greatest(F.col("n_rows"), F.lit(1)), 2).alias("null_pct"),
        _verified_type().alias("data_type"),
        _guess_type(p).alias("guessed_type"),
        # Main-path confidence is a constant (max(0.8, 0.6))
        F.lit(0.8).alias("confidence"),
        N.snake_case(F.col("column")).alias("proposed_name"),
        N.is_forbidden(F.col("column")).alias("forbidden"),
    ).withColumn("type_corrected", F.col("guessed_type") != F.col("data_type"))
    return with_roles(p)


def profile_rows_df(df: DataFrame, cols=None, **kw):
    """Profile once and reuse: returns (rows, small DataFrame built from the
    rows).  The profile has one row per column, so bringing it to the driver
    is bounded by the schema width; every later consumer reads the local
    rows instead of re-running the profiling jobs."""
    p = profile(df, cols, **kw)
    rows = p.collect()
    return rows, df.sparkSession.createDataFrame(rows, p.schema)


def with_roles(p: DataFrame) -> DataFrame:
    """P08/P11 roles: measure | code | cat | date | constant | forbidden."""
    fam = F.col("family")
    dtype = F.col("data_type")
    kind = (
        F.when(dtype == "number", F.lit("num"))
        .when((dtype == "id") & (fam == "numeric"), F.lit("num"))
        .when(dtype == "date", F.lit("date"))
        .otherwise(F.lit("cat"))
    )
    thr = F.greatest(F.lit(10), F.least(F.lit(60), F.floor(F.col("n_rows") * 0.1))).cast("long")
    role = (
        F.when(kind == "date", F.lit("date"))
        .when(F.col("forbidden"), F.lit("forbidden"))
        .when(F.col("nunique") <= 1, F.lit("constant"))
        .when((kind == "num") & (F.col("nunique") <= thr), F.lit("code"))
        .when(kind == "num", F.lit("measure"))
        .otherwise(F.lit("cat"))
    )
    return p.select("*", kind.alias("kind"), thr.alias("code_threshold"), role.alias("role"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, total null cells -- one aggregate pass."""
    cols = df.columns
    nulls = sum((qcol(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("null_cells")).select(
        F.col("rows").cast("long"), F.lit(len(cols)).cast("long").alias("columns"),
        F.coalesce(F.col("null_cells"), F.lit(0)).cast("long").alias("null_cells"))


def column_lists(prof_rows) -> dict:
    """P08 on a collected profile (one row per column): ordered name lists."""
    rows = sorted(prof_rows, key=lambda r: r["ordinal"])
    return {
        "measure": [r["column"] for r in rows if r["role"] == "measure"],
        "code": [r["column"] for r in rows if r["role"] == "code"],
        "cat": [r["column"] for r in rows if r["role"] == "cat"],
        "date": [r["column"] for r in rows if r["role"] == "date"],
        "numeric": [r["column"] for r in rows if r["kind"] == "num" and r["nunique"] > 1],
        "nunique": {r["column"]: r["nunique"] for r in rows},
    }

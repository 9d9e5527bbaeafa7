"""Registered queries: confidence (K01-K06), free-text questions (Q07/Q08),
question plans and dashboards (Q01-Q06), HTML tables (S11-S13), report
header (A21-A23), file round trip (S01-S04, S09) and numeric traits (P16)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import confidence as K
from ..operators.profile import profile
from ..sources import files as FS
from ..sources import html as H
from ..session import ensure_checkpoint_dir
from . import dispatch as DP
from . import questions as Q
from .q_clean import MESSY_COLS, MESSY_SQL, messy_orders, _messy_profile_df
from .q_plans import SALES_SQL, _first_match_sql, sales
from .q_profile import SCHEMAS, _profile_sql
from .registry import ORACLE, query, table, r6
from .report import anomaly_log, missing_cells_pct, proposals_summary, report_header

# ---------------------------------------------------------------- K01 / K05 / K06
INJ = ["o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
       "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice", "o_orderdate",
       "o_orderpriority"]
INJ_SQL = f"(SELECT {', '.join(INJ)} FROM orders)"


def _k01_sql():
    parts = []
    for c, fam in SCHEMAS["orders"]:
        v = f"epoch({c})" if fam == "temporal" else f"CAST({c} AS DOUBLE)" if fam == "numeric" else "NULL::DOUBLE"
        parts.append(f"SELECT '{c}' AS column_name, '{fam}' AS family, count(*) AS n, count(*) - count({c}) AS nulls, "
                     f"count(DISTINCT {c}) AS nunique, avg({v}) AS mean, stddev_samp({v}) AS std FROM {INJ_SQL}")
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}),
k AS (SELECT *, greatest(0.0, 1 - nulls / n) AS completeness,
        CASE WHEN family = 'string' THEN least(1.0, nunique / greatest(1.0, n * 0.1)) * 0.5
             WHEN mean IS NULL OR mean = 0 OR std IS NULL THEN 0.3
             ELSE least(std / abs(mean), 2.0) / 2 * 0.5 END AS variability,
        CASE WHEN family = 'string' THEN nunique / n ELSE least(1.0, std / (mean + 1e-6)) END AS q_var
      FROM s),
c AS (SELECT *, least(1.0, completeness * 0.5 + variability) AS conf FROM k)"""


def _bar(x):
    return (f"CASE WHEN {x} >= 0.85 THEN '█████' WHEN {x} >= 0.70 THEN '████░' "
            f"WHEN {x} >= 0.55 THEN '███░░' ELSE '██░░░' END")


@query("confidence_columns", _k01_sql() + f"""
SELECT column_name, round(conf, 6) AS confidence, {_bar('conf')} AS bar, round(completeness, 6) AS completeness,
       nunique AS unique_values FROM c""")
def confidence_columns(spark, sf):
    cc = K.column_confidence(profile(table(spark, sf, "orders").selectExpr(*INJ)))
    return cc.select(F.col("column").alias("column_name"), r6("confidence_raw").alias("confidence"), "bar",
                     r6("completeness_raw").alias("completeness"), F.col("unique_values").cast("long"))


def _questions_of(cols):
    """Questions built from a schema: each column, each adjacent pair, the
    first three columns, one naming a missing column, and an empty one."""
    qs = [[c] for c in cols] + [[cols[i], cols[i + 1]] for i in range(len(cols) - 1)] + [cols[:3]]
    qs += [[cols[0], "not_a_column"], ["not_a_column"], []]
    return [(i + 1, q) for i, q in enumerate(qs)]


@query("confidence_questions")
def confidence_questions(spark, sf):
    df = table(spark, sf, "orders").selectExpr(*INJ)
    cc = K.column_confidence(profile(df))
    qs = spark.createDataFrame(_questions_of(df.columns), "qid int, columns array<string>")
    out = K.question_confidence(qs, cc)
    return out.select("qid", r6("overall_raw").alias("overall"), r6("completeness_raw").alias("completeness"),
                      r6("variability_raw").alias("variability"), "data_quality",
                      F.size("columns_checked").cast("long").alias("n_checked"),
                      F.size("columns_missing").cast("long").alias("n_missing"))


def _kq_sql():
    cols = [c for c, _ in SCHEMAS["orders"]]
    rows = []
    for qid, q in _questions_of(cols):
        if not q:
            rows.append(f"({qid}, 0, NULL)")
        for pos, c in enumerate(q):
            rows.append(f"({qid}, {pos}, '{c}')")
    return _k01_sql() + f""",
q(qid, pos, col) AS (VALUES {', '.join(rows)}),
j AS (SELECT q.qid, q.col, c.conf, c.completeness, c.q_var FROM q LEFT JOIN c ON c.column_name = q.col),
g AS (SELECT qid, count(conf) AS n_found, avg(conf) AS mean_conf, avg(completeness) AS comp, avg(q_var) AS var,
             count(col) - count(conf) AS n_missing, count(col) AS n_cols FROM j GROUP BY qid),
o AS (SELECT *, CASE WHEN n_found = 0 THEN 0.0 ELSE least(1.0, mean_conf +
         CASE WHEN n_found = 1 THEN 0.0 WHEN n_found = 2 THEN 0.05 ELSE -0.10 END) END AS overall FROM g)
SELECT qid, round(overall, 6) AS overall, round(coalesce(comp, 0.0), 6) AS completeness,
       round(coalesce(var, 0.0), 6) AS variability,
       CASE WHEN n_cols = 0 THEN 'no column' WHEN n_found = 0 THEN 'columns not found'
            WHEN overall >= 0.85 THEN 'excellent' WHEN overall >= 0.70 THEN 'good' WHEN overall >= 0.55 THEN 'medium'
            WHEN overall >= 0.40 THEN 'weak' ELSE 'very weak' END AS data_quality,
       n_found AS n_checked, n_missing
FROM o"""


ORACLE["confidence_questions"] = _kq_sql()


@query("confidence_table", _k01_sql() + """
SELECT round(avg(round(conf, 2)), 2) AS global_confidence, round(avg(conf), 6) AS global_confidence_raw,
       CASE WHEN avg(round(conf, 2)) >= 0.85 THEN 'excellent' WHEN avg(round(conf, 2)) >= 0.70 THEN 'good'
            ELSE 'medium' END AS quality_summary, count(*) AS n_columns FROM c""")
def confidence_table(spark, sf):
    cc = K.column_confidence(profile(table(spark, sf, "orders").selectExpr(*INJ)))
    t = K.table_confidence(cc)
    return t.select("global_confidence", r6("global_confidence_raw").alias("global_confidence_raw"),
                    "quality_summary", "n_columns")


# ---------------------------------------------------------------- Q07
@query("question_intent", f"""
SELECT conv_id, turn, {_first_match_sql('lower(text)', Q.INTENT_WORDS, 'bar')} AS intent FROM conversations""")
def question_intent(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", Q.question_intent("text").alias("intent"))


def _answers_sql():
    from .q_agg import _hist_sql

    j = """(SELECT o.o_orderstatus, o.o_totalprice AS revenue, c.c_mktsegment, r.r_name AS region
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

    def hist(qid, chart, nbins):
        return (f"SELECT {qid} AS qid, '{chart}' AS chart, 'revenue' AS series, CAST(bin AS VARCHAR) AS x, "
                f"CAST(n AS DOUBLE) AS y, lo AS x_lo, hi AS x_hi, NULL AS extra FROM ({_hist_sql(j, 'revenue', nbins)})")

    def mean2(qid, cat):
        return (f"SELECT {qid}, 'bar', o_orderstatus, {cat}, round(avg(revenue), 6), NULL, NULL, "
                f"CAST(count(revenue) AS VARCHAR) FROM {j} WHERE {cat} IS NOT NULL AND o_orderstatus IS NOT NULL "
                f"GROUP BY o_orderstatus, {cat}")

    def mean1(qid, cat):
        return (f"SELECT {qid}, 'dtype:bar', 'revenue', {cat}, round(avg(revenue), 6), NULL, NULL, "
                f"CAST(count(revenue) AS VARCHAR) FROM {j} WHERE {cat} IS NOT NULL GROUP BY {cat}")

    cross = f"""SELECT 4, 'dtype:heatmap', lb.b, la.a, CAST(coalesce(c.n, 0) AS DOUBLE), NULL, NULL, NULL
FROM (SELECT DISTINCT c_mktsegment AS a FROM {j} WHERE c_mktsegment IS NOT NULL AND region IS NOT NULL) la
CROSS JOIN (SELECT DISTINCT region AS b FROM {j} WHERE c_mktsegment IS NOT NULL AND region IS NOT NULL) lb
LEFT JOIN (SELECT c_mktsegment AS a, region AS b, count(*) AS n FROM {j}
           WHERE c_mktsegment IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2) c ON c.a = la.a AND c.b = lb.b"""
    parts = [mean2(1, "c_mktsegment"), mean2(2, "region"),
             hist(3, "histogram", "least(40, greatest(10, CAST(floor(sqrt(n)) AS INTEGER)))"),
             mean1(1, "c_mktsegment"), mean1(2, "region"), hist(3, "dtype:histogram", "20"), cross]
    body = " UNION ALL ".join(f"({x})" for x in parts)
    return f"""
SELECT CAST(qid AS INTEGER) AS qid, chart, series, x, CAST(y AS DOUBLE) AS y, CAST(x_lo AS DOUBLE) AS x_lo,
       CAST(x_hi AS DOUBLE) AS x_hi, CAST(extra AS VARCHAR) AS extra
FROM ({body}) AS t(qid, chart, series, x, y, x_lo, x_hi, extra)"""


@query("question_answers", _answers_sql())
def question_answers(spark, sf):
    d = sales(spark, sf)
    prof = profile(d).collect()
    qs = Q.plan_questions(prof)
    return DP.answer_questions(d, qs, prof, policy="chart").unionByName(
        DP.answer_questions(d, qs, prof, policy="dtype").withColumn("chart", F.concat(F.lit("dtype:"), "chart")))


def _dashboard_sql():
    """The dashboard of the sales, chart by chart: order keys and revenues are nearly unique, so the balance is the main metric."""
    from .q_agg import _hist_sql

    none = "NULL, NULL, NULL"
    bins = "least(40, greatest(10, CAST(floor(sqrt(n)) AS INTEGER)))"

    def hist(qid, c):
        return f"SELECT {qid}, 'histogram', '{c}', CAST(bin AS VARCHAR), CAST(n AS DOUBLE), lo, hi, NULL FROM ({_hist_sql(SALES_SQL, c, bins)})"

    def means(qid, c):
        return (f"SELECT {qid}, 'bar', o_orderstatus, {c}, round(avg(c_acctbal), 6), NULL, NULL, CAST(count(c_acctbal) AS VARCHAR) FROM j "
                f"WHERE {c} IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderstatus, {c}")

    def cross(qid, chart, a, b, first=""):
        return f"""SELECT {qid}, '{chart}', lb.b, la.a, CAST(coalesce(c.n, 0) AS DOUBLE), {none}
FROM (SELECT DISTINCT {a} AS a FROM j WHERE {a} IS NOT NULL AND {b} IS NOT NULL {first}) la CROSS JOIN (SELECT DISTINCT {b} AS b FROM j WHERE {a} IS NOT NULL AND {b} IS NOT NULL) lb
LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM j GROUP BY 1, 2) c ON c.a = la.a AND c.b = lb.b"""

    numbers = ["o_orderkey", "revenue", "c_acctbal"]
    pairs = [f"SELECT 7, 'heatmap', '{a}', '{b}', round(corr({a}, {b}), 6), {none} FROM j" for i, a in enumerate(numbers) for b in numbers[i + 1:]]
    dims = ["c_mktsegment", "region", "o_orderstatus"]
    held = " AND ".join(f"{d} IS NOT NULL" for d in dims)
    parts = [
        hist(1, "c_acctbal"),
        f"""SELECT 2, 'box', 'c_acctbal', x, round(CAST(y AS DOUBLE), 6), {none} FROM (
SELECT unnest([{', '.join(f"struct_pack(x := '{n}', y := CAST({e} AS DOUBLE))" for n, e in (("q1", "q1"), ("median", "m"), ("q3", "q3"), ("mean", "mean"), ("n_outliers", "n_out")))}], recursive := true)
FROM (SELECT *, (SELECT count(*) FROM j WHERE c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1)) AS n_out FROM (
  SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS mean FROM j)))""",
        means(3, "c_mktsegment"), means(4, "region"), cross(5, "heatmap", "c_mktsegment", "region"), cross(6, "bar", "o_orderstatus", "o_orderpriority", "ORDER BY 1 LIMIT 10"), *pairs,
        f"SELECT 8, 'bubble', o_orderstatus, CAST(CAST(o_orderkey AS DOUBLE) AS VARCHAR), round(revenue, 6), NULL, NULL, CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR) FROM j WHERE o_orderkey IS NOT NULL AND revenue IS NOT NULL",
        f"""SELECT 9, 'sunburst', CAST({' + '.join(f'({d} IS NOT NULL)::INTEGER' for d in dims)} AS VARCHAR), concat_ws('/', {', '.join(f"coalesce({d}, '')" for d in dims)}), round(sum(c_acctbal), 6), {none}
FROM j WHERE {held} GROUP BY ROLLUP ({', '.join(dims)})""",
        f"SELECT 10, 'sankey', c_mktsegment, region, round(sum(c_acctbal), 6), {none} FROM j WHERE c_mktsegment IS NOT NULL AND region IS NOT NULL GROUP BY 3, 4",
        hist(11, "o_orderkey"), hist(12, "revenue"), cross(13, "bar", "o_orderpriority", "o_orderstatus", "ORDER BY 1 LIMIT 10")]
    body = " UNION ALL ".join(f"({x})" for x in parts)
    return f"""
WITH j AS {SALES_SQL}
SELECT CAST(qid AS INTEGER) AS qid, chart, series, x, CAST(y AS DOUBLE) AS y, CAST(x_lo AS DOUBLE) AS x_lo,
       CAST(x_hi AS DOUBLE) AS x_hi, CAST(extra AS VARCHAR) AS extra
FROM ({body}) AS t(qid, chart, series, x, y, x_lo, x_hi, extra)"""


@query("auto_analyze", _dashboard_sql())
def auto_analyze(spark, sf):
    d = sales(spark, sf)
    prof = profile(d).collect()
    return DP.auto_analyze(d, prof)


# ---------------------------------------------------------------- S11 - S13
TABLE_HTML = """concat(html,
 '<table><thead><tr><th> key </th><th>name &amp; co</th><th colspan="1">val</th></tr></thead><tbody>',
 array_join(transform(sequence(1, CAST(page_id % 4 + 1 AS INT)), r -> concat('<tr><td>', CAST(r AS STRING),
   '</td><td>', CASE WHEN (page_id + r) % 3 = 0 THEN '' ELSE concat('n', CAST(r AS STRING)) END,
   '</td><td>', CAST(page_id * r AS STRING), '</td></tr>')), ''),
 CASE WHEN page_id % 5 = 0 THEN '<tr><td></td><td> </td><td></td></tr>' ELSE '' END,
 '</tbody></table>',
 CASE WHEN page_id % 2 = 0 THEN '<table><tr><th>a</th><th>b</th></tr><tr><td>x<td>y</table>' ELSE '' END) AS html"""

_T0 = """SELECT page_id, CAST(0 AS BIGINT) AS table_no, page_id % 4 + 1 AS rows, CAST(3 AS BIGINT) AS columns,
  round(100.0 * len(list_filter(range(1, page_id % 4 + 2), lambda r: (page_id + r) % 3 = 0)) / (3 * (page_id % 4 + 1)), 2) AS missing_pct,
  'key|name & co|val' AS column_names,
  'int64|' || CASE WHEN len(list_filter(range(1, page_id % 4 + 2), lambda r: (page_id + r) % 3 = 0)) = page_id % 4 + 1
                   THEN 'float64' ELSE 'object' END || '|int64' AS dtypes
FROM pages"""
_T1 = """SELECT page_id, CAST(1 AS BIGINT) AS table_no, CAST(1 AS BIGINT) AS rows, CAST(2 AS BIGINT) AS columns,
  CAST(0.0 AS DOUBLE) AS missing_pct, 'a|b' AS column_names,
  'object|object' AS dtypes FROM pages WHERE page_id % 2 = 0"""


def _pages_with_tables(spark, sf):
    return table(spark, sf, "pages").selectExpr("page_id", "url", TABLE_HTML)


def _stats_out(s):
    return s.select(F.col("page_id").cast("long"), F.col("table_no").cast("long"), F.col("rows").cast("long"),
                    F.col("columns").cast("long"), F.col("missing_pct").cast("double"),
                    F.concat_ws("|", "column_names").alias("column_names"), F.concat_ws("|", "dtypes").alias("dtypes"))


@query("html_tables_best", _T0)
def html_tables_best(spark, sf):
    return _stats_out(H.best_table(_pages_with_tables(spark, sf)))


@query("html_table_stats", _T0 + " UNION ALL " + _T1)
def html_table_stats(spark, sf):
    return _stats_out(H.table_stats(_pages_with_tables(spark, sf)))


# ---------------------------------------------------------------- A21 - A23
_ANOMALY_SQL = ORACLE["anomaly_log"]


@query("report_header", f"""
SELECT (SELECT count(*) FROM {MESSY_SQL}) AS rows, CAST(5 AS BIGINT) AS columns, (SELECT count(*) FROM ({_ANOMALY_SQL})) AS anomalies,
       CAST(80.0 AS DOUBLE) AS mean_confidence_pct, CAST(76.0 AS DOUBLE) AS quality_pct""")
def report_header_q(spark, sf):
    d, prof_rows, p = _messy_profile_df(spark, sf)
    return report_header(p, anomaly_log(d, prof_rows))


@query("proposals_summary", f"""
SELECT CAST(5 AS BIGINT) AS columns, CAST(0.8 AS DOUBLE) AS mean_confidence,
  (SELECT count(DISTINCT data_type) FROM ({_profile_sql(MESSY_SQL, MESSY_COLS)})) AS distinct_types,
  (SELECT round(avg(k), 4) FROM (SELECT count(*) AS k FROM ({_ANOMALY_SQL}) GROUP BY "column")) AS anomalies_per_column""")
def proposals_summary_q(spark, sf):
    d, prof_rows, p = _messy_profile_df(spark, sf)
    s = proposals_summary(p, anomaly_log(d, prof_rows))
    return s.select(F.col("columns").cast("long"), F.col("mean_confidence").cast("double"),
                    F.col("distinct_types").cast("long"), "anomalies_per_column")


@query("missing_cells", f"""
SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns,
  CAST(sum(("Order ID" IS NULL)::BIGINT + (Montant IS NULL)::BIGINT + (Statut IS NULL)::BIGINT
      + ("Date Commande" IS NULL)::BIGINT + (priorite IS NULL)::BIGINT) AS BIGINT) AS null_cells,
  round(100.0 * sum(("Order ID" IS NULL)::BIGINT + (Montant IS NULL)::BIGINT + (Statut IS NULL)::BIGINT
      + ("Date Commande" IS NULL)::BIGINT + (priorite IS NULL)::BIGINT) / (count(*) * 5), 2) AS missing_pct
FROM {MESSY_SQL}""")
def missing_cells(spark, sf):
    return missing_cells_pct(messy_orders(spark, sf))


# ---------------------------------------------------------------- S01 - S04, S09 round trip
@query("csv_roundtrip", """
SELECT count(*) AS rows, 6 AS columns, ';' AS sep, 'UTF-8' AS encoding,
       round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_price,
       count(DISTINCT o_orderpriority) AS priorities
FROM orders""")
def csv_roundtrip(spark, sf):
    """Write orders as ';'-separated CSV into the shared checkpoint folder
    (S09), read it back with separator/encoding sniffing, all-string (S01-S04)."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv-{uuid.uuid4().hex}")
    FS.write_table(table(spark, sf, "orders"), path, sep=";")
    sniff = FS.sniff_files(spark, path).select("sep", "encoding").distinct()
    back = FS.read_any(spark, path, fmt=".csv")
    from ..functions.numbers import clean_number_basic
    agg = back.agg(F.count(F.lit(1)).alias("rows"),
                   F.round(F.sum(clean_number_basic("o_totalprice").cast("decimal(18,2)")).cast("double"), 2)
                   .alias("total_price"),
                   F.count_distinct("o_orderpriority").alias("priorities"))
    found = sniff.collect()  # one row per distinct (separator, encoding): tiny
    return agg.select("rows", F.lit(len(back.columns)).alias("columns"),
                      F.lit(",".join(sorted({r["sep"] for r in found}))).alias("sep"),
                      F.lit(",".join(sorted({r["encoding"] for r in found}))).alias("encoding"),
                      "total_price", "priorities")


# ---------------------------------------------------------------- P16 numeric traits
NUMS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_traits", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE))) AS is_integral, "
    f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in NUMS))
def numeric_traits(spark, sf):
    p = profile(table(spark, sf, "lineitem"), NUMS)
    return p.select(F.col("column").alias("column_name"), "is_integral", r6("mean").alias("mean"),
                    r6("std").alias("std"), "min", "max")


# ---------------------------------------------------------------- C16 on Structured Streaming
@query("clean_stream_orders", ORACLE["clean_table_orders"])
def clean_stream_orders(spark, sf):
    """The messy orders are landed as Parquet files in the shared checkpoint
    folder, profiled once (batch), then cleaned by a streaming query
    (``availableNow`` trigger, checkpointed, exactly-once file sink); the
    sink is read back.  Same result as the batch ``clean_table_orders``."""
    from ..streaming.clean_stream import run_clean_stream

    base = ensure_checkpoint_dir(spark)
    run = uuid.uuid4().hex
    src, sink = os.path.join(base, f"stream-src-{run}"), os.path.join(base, f"stream-out-{run}")
    d = messy_orders(spark, sf)
    d.write.parquet(src)
    landed = spark.read.parquet(src)
    prof = profile(landed).collect()
    q = run_clean_stream(spark, src, landed.schema, prof, sink, name=run)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.withColumn("date_commande", F.col("date_commande").cast("string"))

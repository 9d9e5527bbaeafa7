"""Registered queries: chart aggregates, statistics, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg as A
from ..operators import series as S
from ..operators import stats as ST
from ..operators.profile import profile
from .registry import query, table, r6


# ---------------------------------------------------------------- A01 / A02 / T03
@query("top_values", """
SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (
  SELECT CAST(p_name AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1)
ORDER BY n DESC, value LIMIT 10""")
def top_values(spark, sf):
    return A.top_values(table(spark, sf, "part"), "p_name", 10)


@query("value_shares", """
WITH c AS (SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1),
t AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c ORDER BY n DESC, value LIMIT 8)
SELECT value, n, rank, round(n / sum(n) OVER (), 6) AS share,
       round(n / (SELECT sum(n) FROM c), 6) AS share_of_all FROM t""")
def value_shares(spark, sf):
    s = A.value_shares(table(spark, sf, "events"), "event_type", 8)
    return s.select("value", "n", "rank", r6("share").alias("share"), r6("share_of_all").alias("share_of_all"))


# ---------------------------------------------------------------- A03 / A04
@query("two_way_auto", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2),
la AS (SELECT DISTINCT a FROM c ORDER BY a LIMIT 10),
lb AS (SELECT DISTINCT b FROM c)
SELECT la.a, lb.b, coalesce(c.n, 0) AS n FROM la CROSS JOIN lb LEFT JOIN c ON c.a = la.a AND c.b = lb.b""")
def two_way_auto(spark, sf):
    li = table(spark, sf, "lineitem")
    # only text columns can be the categorical second dimension: profile just those
    prof = profile(li, [c for c, t in li.dtypes if t == "string"]).collect()
    return A.two_way_auto(li, "l_returnflag", prof, top_n=10).select("a", "b", F.col("n").cast("long"))


SPARSE = ["o_orderpriority AS a",
          "CASE WHEN o_totalprice >= 450000 THEN 'xl' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'std' END AS b"]


@query("crosstab_zero_filled", f"""
WITH d AS (SELECT {', '.join(SPARSE)} FROM orders),
c AS (SELECT a, b, count(*) AS n FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
la AS (SELECT DISTINCT a FROM c), lb AS (SELECT DISTINCT b FROM c)
SELECT la.a, lb.b, coalesce(c.n, 0) AS n FROM la CROSS JOIN lb LEFT JOIN c ON c.a = la.a AND c.b = lb.b""")
def crosstab_zero_filled(spark, sf):
    d = table(spark, sf, "orders").selectExpr(*SPARSE)
    return A.crosstab(d, "a", "b").select("a", "b", F.col("n").cast("long"))


# ---------------------------------------------------------------- A05 - A07 / T02
@query("mean_by_cat", """
SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(38,2))) AS DOUBLE) / count(l_extendedprice), 6) AS mean,
       count(l_extendedprice) AS n
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def mean_by_cat(spark, sf):
    g = A.mean_by_category(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", decimals=2)
    return g.select("l_returnflag", r6("mean").alias("mean"), "n")


@query("mean_by_two", """
SELECT c.c_mktsegment, o.o_orderstatus AS second,
       round(CAST(sum(CAST(o.o_totalprice AS DECIMAL(38,2))) AS DOUBLE) / count(o.o_totalprice), 6) AS mean,
       count(o.o_totalprice) AS n
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def mean_by_two(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    j = o.join(c, "o_custkey").select("c_mktsegment", "o_orderstatus", "o_totalprice")
    prof = profile(j).collect()  # auto second dimension: first other category with 2-7 labels
    g = A.mean_by_two(j, "c_mktsegment", "o_totalprice", prof_rows=prof, decimals=2)
    return g.select("c_mktsegment", "second", r6("mean").alias("mean"), "n")


@query("mean_scaled", """
WITH g AS (SELECT l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(38,2))) AS DOUBLE) / count(l_quantity) AS mean
           FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY 1)
SELECT l_linestatus, round(mean, 6) AS mean,
       round(CASE WHEN max(mean) OVER () > min(mean) OVER ()
                  THEN (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) ELSE 0.5 END, 6) AS scaled
FROM g""")
def mean_scaled(spark, sf):
    g = A.mean_by_category(table(spark, sf, "lineitem"), "l_linestatus", "l_quantity", decimals=2)
    return A.mean_scaled(g).select("l_linestatus", r6("mean").alias("mean"), r6("scaled").alias("scaled"))


# ---------------------------------------------------------------- A08 - A10
def _hist_sql(src: str, col: str, nbins: str) -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL),
s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v),
k AS (SELECT lo, hi, {nbins} AS k, (hi - lo) / ({nbins}) AS w FROM s),
c AS (SELECT CASE WHEN k.w > 0 THEN least(CAST(floor((v.v - k.lo) / k.w) AS INTEGER), k.k - 1) ELSE 0 END AS bin,
             count(*) AS n FROM v, k GROUP BY 1),
b AS (SELECT unnest(range(0, k)) AS bin, lo, hi, k, w FROM k)
SELECT b.bin, round(b.lo + b.bin * b.w, 6) AS lo,
       round(CASE WHEN b.bin = b.k - 1 THEN b.hi ELSE b.lo + (b.bin + 1) * b.w END, 6) AS hi,
       coalesce(c.n, 0) AS n
FROM b LEFT JOIN c USING (bin)"""


def _hist_out(h):
    return h.select(F.col("bin").cast("long").alias("bin"), r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("histogram_auto", _hist_sql("lineitem", "l_extendedprice",
                                   "least(40, greatest(10, CAST(floor(sqrt(n)) AS INTEGER)))"))
def histogram_auto(spark, sf):
    return _hist_out(A.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("histogram_20", _hist_sql("orders", "o_totalprice", "20"))
def histogram_20(spark, sf):
    return _hist_out(A.histogram(table(spark, sf, "orders"), "o_totalprice", 20))


def _date_hist_sql(src: str, col: str, label: str) -> str:
    return f"""
SELECT '{label}' AS source, CAST(CAST(date_trunc(unit, {col}) AS DATE) AS VARCHAR) AS period, count(*) AS n, unit
FROM {src}, (SELECT CASE WHEN span <= 62 THEN 'day' WHEN span <= 1096 THEN 'month' ELSE 'year' END AS unit
             FROM (SELECT (epoch(max({col})) - epoch(min({col}))) / 86400.0 AS span FROM {src}))
WHERE {col} IS NOT NULL GROUP BY period, unit"""


@query("date_histogram", _date_hist_sql("events", "ts", "events.ts") + " UNION ALL " +
       _date_hist_sql("orders", "o_orderdate", "orders.o_orderdate"))
def date_histogram(spark, sf):
    e = A.date_histogram(table(spark, sf, "events"), "ts").withColumn("source", F.lit("events.ts"))
    o = A.date_histogram(table(spark, sf, "orders"), "o_orderdate").withColumn("source", F.lit("orders.o_orderdate"))
    return e.unionByName(o).select("source", F.col("period").cast("string").alias("period"), "n", "unit")


# ---------------------------------------------------------------- A11 - A14
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for i in range(len(CORR_COLS)):
        for j in range(i + 1, len(CORR_COLS)):
            a, b = CORR_COLS[i], CORR_COLS[j]
            parts.append(f"SELECT '{a}' AS c1, '{b}' AS c2, round(corr({a}, {b}), 6) AS r, "
                         f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM lineitem")
    return " UNION ALL ".join(parts)


@query("correlation_matrix", _corr_sql())
def correlation_matrix(spark, sf):
    m = ST.correlation_matrix(table(spark, sf, "lineitem"), CORR_COLS)
    return m.select("c1", "c2", r6("r").alias("r"), "n")


@query("boxplot_stats", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
                  avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n, min(value) AS mn, max(value) AS mx
           FROM events)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
       round(mean, 6) AS mean, round(std, 6) AS std, n, round(mn, 6) AS min, round(mx, 6) AS max,
       (SELECT count(*) FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM q""")
def boxplot_stats(spark, sf):
    b = ST.boxplot_stats(table(spark, sf, "events"), "value")
    return b.select(*[r6(c).alias(c) if c not in ("n", "n_outliers") else F.col(c) for c in b.columns])


@query("iqr_outliers", """
WITH l AS (SELECT 'value' AS "column", CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL
           UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id IS NOT NULL),
f AS (SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY 1),
g AS (SELECT "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM f)
SELECT g."column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper,
       count(l.v) AS n_outliers
FROM g LEFT JOIN l ON l."column" = g."column" AND (l.v < g.lower OR l.v > g.upper)
GROUP BY g."column", q1, q3, lower, upper""")
def iqr_outliers(spark, sf):
    o = ST.iqr_outliers(table(spark, sf, "events"), ["value", "user_id"])
    return o.select("column", r6("q1").alias("q1"), r6("q3").alias("q3"), r6("lower").alias("lower"),
                    r6("upper").alias("upper"), "n_outliers")


@query("linear_trend", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
                  corr(l_quantity, l_extendedprice) AS r, count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max
           FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
p AS (SELECT unnest(range(0, 100)) AS i, * FROM s WHERE n >= 3)
SELECT i, round(x_min + i * (x_max - x_min) / 99, 6) AS x,
       round(intercept + slope * (x_min + i * (x_max - x_min) / 99), 4) AS y,
       round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, n FROM p""")
def linear_trend(spark, sf):
    _, line = ST.linear_trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select(F.col("i").cast("long").alias("i"), r6("x").alias("x"), F.round("y", 4).alias("y"),
                       r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r").alias("r"), "n")


# ---------------------------------------------------------------- A15 - A18
HIER = """(SELECT r.r_name, n.n_name, c.c_mktsegment, c.c_acctbal FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def _hier_df(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select("r_name", "n_name", "c_mktsegment", "c_acctbal"))


@query("hierarchy_rollup", f"""
SELECT r_name, n_name, c_mktsegment,
       (r_name IS NOT NULL)::INTEGER + (n_name IS NOT NULL)::INTEGER + (c_mktsegment IS NOT NULL)::INTEGER AS level,
       round(CAST(sum(CAST(c_acctbal AS DECIMAL(38,2))) AS DOUBLE), 2) AS value, count(*) AS n
FROM {HIER} WHERE r_name IS NOT NULL AND n_name IS NOT NULL AND c_mktsegment IS NOT NULL
GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def hierarchy_rollup(spark, sf):
    d = _hier_df(spark, sf).withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(38,2)"))
    h = A.hierarchy_rollup(d, ["r_name", "n_name", "c_mktsegment"], "c_acctbal")
    return h.select("r_name", "n_name", "c_mktsegment", "level",
                    F.round(F.col("value").cast("double"), 2).alias("value"), F.col("n_rows").cast("long").alias("n"))


@query("flow_edges", f"""
WITH e AS (SELECT r_name AS source, c_mktsegment AS target, count(*) AS value FROM {HIER}
           WHERE r_name IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY 1, 2),
nodes AS (SELECT side, label, row_number() OVER (ORDER BY side, label) - 1 AS node_id FROM (
  SELECT DISTINCT 0 AS side, source AS label FROM e UNION SELECT DISTINCT 1, target FROM e))
SELECT e.source, e.target, s.node_id AS source_id, t.node_id AS target_id, CAST(e.value AS DOUBLE) AS value
FROM e JOIN nodes s ON s.side = 0 AND s.label = e.source JOIN nodes t ON t.side = 1 AND t.label = e.target""")
def flow_edges(spark, sf):
    f = A.flow_edges(_hier_df(spark, sf), "r_name", "c_mktsegment")
    return f.select("source", "target", F.col("source_id").cast("long"), F.col("target_id").cast("long"), "value")


@query("bubble_projection", """
SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_discount AS DOUBLE) AS size,
       l_returnflag AS colour
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL""")
def bubble_projection(spark, sf):
    """Every row with x and y."""
    return A.bubble_projection(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_discount",
                               "l_returnflag")


@query("bounded_sample", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey) LIMIT 1000""")
def bounded_sample(spark, sf):
    """Deterministic 1,000-row sample of orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return A.bounded_sample(orders, 1000, ["o_orderkey"])


# ---------------------------------------------------------------- W01 - W03 / T01
@query("rolling_by_type", """
SELECT event_type, event_id, row_idx, value,
  round(CASE WHEN n > 100 THEN rm ELSE value END, 6) AS rolling_mean,
  CASE WHEN n > 10 THEN bmin END AS band_min, CASE WHEN n > 10 THEN bmax END AS band_max
FROM (SELECT event_type, event_id, value,
        row_number() OVER w - 1 AS row_idx, count(*) OVER (PARTITION BY event_type) AS n,
        avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rm,
        min(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bmin,
        max(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bmax
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))""")
def rolling_by_type(spark, sf):
    r = S.rolling(table(spark, sf, "events"), "ts", "value", partition_cols=["event_type"], tiebreak=["event_id"])
    return r.select("event_type", "event_id", F.col("row_idx").cast("long"), "value",
                    r6("rolling_mean").alias("rolling_mean"), "band_min", "band_max")


@query("rolling_global", """
SELECT event_id, row_idx, value,
  round(CASE WHEN n > 100 THEN rm ELSE value END, 6) AS rolling_mean,
  CASE WHEN n > 10 THEN bmin END AS band_min, CASE WHEN n > 10 THEN bmax END AS band_max
FROM (SELECT event_id, value, row_number() OVER w - 1 AS row_idx, count(*) OVER () AS n,
        avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rm,
        min(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bmin,
        max(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS bmax
      FROM events WHERE ts IS NOT NULL AND value IS NOT NULL WINDOW w AS (ORDER BY ts, event_id))""")
def rolling_global(spark, sf):
    """Global series without a single-task window (chunked plan)."""
    r = S.rolling(table(spark, sf, "events"), "ts", "value", tiebreak=["event_id"])
    return r.select("event_id", F.col("row_idx").cast("long"), "value",
                    r6("rolling_mean").alias("rolling_mean"), "band_min", "band_max")


@query("monotonic_test", """
SELECT 'event_id' AS column_name, count(*) AS n, count(*) >= 3 AND (bool_and(coalesce(p <= v, true)) OR bool_and(coalesce(p >= v, true))) AS monotonic,
       bool_and(coalesce(p <= v, true)) AS increasing, bool_and(coalesce(p >= v, true)) AS decreasing
FROM (SELECT CAST(event_id AS DOUBLE) AS v, lag(CAST(event_id AS DOUBLE)) OVER (ORDER BY ts, event_id) AS p FROM events)
UNION ALL
SELECT 'value', count(*), count(*) >= 3 AND (bool_and(coalesce(p <= v, true)) OR bool_and(coalesce(p >= v, true))),
       bool_and(coalesce(p <= v, true)), bool_and(coalesce(p >= v, true))
FROM (SELECT value AS v, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL)""")
def monotonic_test(spark, sf):
    ev = table(spark, sf, "events")
    a = S.is_monotonic(ev, "event_id", ["ts", "event_id"]).select(F.lit("event_id").alias("column_name"), "*")
    b = S.is_monotonic(ev, "value", ["ts", "event_id"]).select(F.lit("value").alias("column_name"), "*")
    return a.unionByName(b)


# ---------------------------------------------------------------- T02 / P09
@query("mean_rank", """
SELECT p_brand, round(avg(p_retailprice), 6) AS mean, count(p_retailprice) AS n, row_number() OVER (ORDER BY round(avg(p_retailprice), 6) DESC, p_brand) AS rank
FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def mean_rank(spark, sf):
    """Every category with its place by mean."""
    means = A.mean_by_category(table(spark, sf, "part"), "p_brand", "p_retailprice").withColumn("mean", r6("mean"))
    return A.ranked(means, "mean", "p_brand")


SEQUENCES = ["event_id", "ts", "CASE WHEN event_id % 100 = 0 THEN event_id - 1 ELSE event_id END AS nearly", "(event_id * 7919) % 100003 AS mixed", "value"]


@query("identifier_like_in_order", f"""
WITH e AS (SELECT {', '.join(SEQUENCES)} FROM events),
l AS (SELECT 'nearly' AS c, CAST(nearly AS DOUBLE) AS v, ts, event_id FROM e UNION ALL SELECT 'mixed', CAST(mixed AS DOUBLE), ts, event_id FROM e UNION ALL SELECT 'value', value, ts, event_id FROM e),
s AS (SELECT c, v, lag(v) OVER (PARTITION BY c ORDER BY ts, event_id, v) AS p FROM l WHERE v IS NOT NULL),
a AS (SELECT c, count(*) AS nn, count(DISTINCT v) AS nd, bool_and(coalesce(p <= v, true)) OR bool_and(coalesce(p >= v, true)) AS monotonic FROM s GROUP BY c)
SELECT c AS column_name, nn >= 3 AND (nd / nn >= 0.995 OR (nd / nn >= 0.98 AND monotonic)) AS identifier_like FROM a""")
def identifier_like_in_order(spark, sf):
    """P09 with an order: columns that are nearly unique and run with the events."""
    from .dispatch import identifier_like

    d = table(spark, sf, "events").selectExpr(*SEQUENCES)
    prof = profile(d, ["nearly", "mixed", "value"]).collect()
    return spark.createDataFrame([(c, identifier_like(d, c, prof, ["ts", "event_id"])) for c in ("nearly", "mixed", "value")], "column_name string, identifier_like boolean")

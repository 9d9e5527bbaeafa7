"""Registered queries: cleaners, dictionaries, whole-table cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..operators import clean as C
from ..operators import fuzzy as Z
from ..operators.confidence import column_confidence
from ..operators.profile import profile_rows_df
from .q_profile import _profile_sql
from .registry import query, table, r6
from .report import anomaly_log, cleaning_report

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SCI_RE = r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"
PLAIN_RE = r"^-?(\d+\.?\d*|\.\d+)$"
EMPTY = "('', 'nan', 'null', 'none', '?', 'inconnu', '-', '--')"


def staged(df, *stages):

    for s in stages:
        df = df.selectExpr(*s)
    return df


def staged_sql(src, *stages):
    sql = f"SELECT * FROM {src}"
    for s in stages:
        sql = f"SELECT {', '.join(s)} FROM ({sql})"
    return sql


# ---------------------------------------------------------------- flagship
@query("mean_revenue_by_segment", """
SELECT c.c_mktsegment, round(CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS mean_totalprice,
       count(*) AS n_orders
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment""")
def mean_revenue_by_segment(spark, sf):
    """Which customer segment brings the most revenue: orders are reduced
    to one (sum, count) per customer BEFORE the join (map-side combined),
    so the join and the final group-by see one row per customer."""
    o = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    per_cust = o.groupBy("o_custkey").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("c"))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    j = per_cust.join(cust, "o_custkey")
    g = j.groupBy("c_mktsegment").agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    return g.select("c_mktsegment", r6(F.col("s").cast("double") / F.col("n")).alias("mean_totalprice"),
                    F.col("n").alias("n_orders"))


# ---------------------------------------------------------------- C01 / C02
CENTS = [["l_orderkey", "l_linenumber",
          "(l_orderkey * 7919 + l_linenumber * 104729) % 10000000 AS cents"],
         ["l_orderkey", "l_linenumber", "cents", "CAST((cents - cents % 100) / 100 AS BIGINT) AS euros",
          "lpad(CAST(cents % 100 AS STRING), 2, '0') AS cc"],
         ["l_orderkey", "l_linenumber", "cents", "euros", "cc",
          "CAST((euros - euros % 1000) / 1000 AS BIGINT) AS th", "lpad(CAST(euros % 1000 AS STRING), 3, '0') AS un"]]

BASIC_RAW = ["l_orderkey", "l_linenumber", """CASE (l_orderkey + l_linenumber) % 8
  WHEN 0 THEN CAST(euros AS STRING) || ',' || cc
  WHEN 1 THEN ' ' || CAST(euros AS STRING) || '.' || cc || ' '
  WHEN 2 THEN '-' || CAST(euros AS STRING) || ',' || cc
  WHEN 3 THEN CAST(cents AS STRING) || 'e-2'
  WHEN 4 THEN 'abc'
  WHEN 5 THEN ''
  WHEN 6 THEN NULL
  ELSE CAST(euros AS STRING) || 'f' END AS raw"""]

LOCALE_RAW = ["l_orderkey", "l_linenumber", """CASE (l_orderkey + l_linenumber) % 9
  WHEN 0 THEN CASE WHEN th > 0 THEN CAST(th AS STRING) || ' ' || un ELSE CAST(euros AS STRING) END || ',' || cc || ' €'
  WHEN 1 THEN CASE WHEN th > 0 THEN CAST(th AS STRING) || '.' || un ELSE CAST(euros AS STRING) END || ',' || cc
  WHEN 2 THEN CASE WHEN th > 0 THEN CAST(th AS STRING) || ',' || un ELSE CAST(euros AS STRING) END || '.' || cc
  WHEN 3 THEN '$' || CAST(euros AS STRING) || '.' || cc
  WHEN 4 THEN cc || '%'
  WHEN 5 THEN CAST(euros AS STRING) || 'e2'
  WHEN 6 THEN CAST(euros AS STRING) || ' kg'
  WHEN 7 THEN CASE WHEN th > 0 THEN CAST(th AS STRING) || ',' || un || ',' || cc ELSE 'n/a' END
  ELSE NULL END AS raw"""]

_c01 = f"CASE WHEN regexp_matches(replace(trim(raw), ',', '.'), '{NUM_RE}') THEN TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) END"


@query("clean_number_basic", f"""
SELECT l_orderkey, l_linenumber, raw, {_c01} AS cleaned
FROM ({staged_sql('lineitem', *CENTS, BASIC_RAW)})""")
def clean_number_basic(spark, sf):
    d = staged(table(spark, sf, "lineitem"), *CENTS, BASIC_RAW)
    return d.select("l_orderkey", "l_linenumber", "raw", N.clean_number_basic("raw").alias("cleaned"))


_c02 = f"""
CASE WHEN regexp_full_match(s0, '{SCI_RE}') THEN TRY_CAST(s0 AS DOUBLE)
     WHEN regexp_full_match(nrm, '{PLAIN_RE}') THEN TRY_CAST(nrm AS DOUBLE) END"""


@query("clean_number_locale", f"""
WITH a AS (SELECT *, regexp_replace(raw, '[€$£%\\s\\x{{00a0}}\\x{{202f}}]', '', 'g') AS s0
           FROM ({staged_sql('lineitem', *CENTS, LOCALE_RAW)})),
b AS (SELECT *, regexp_replace(s0, '[^0-9.,\\-]', '', 'g') AS s1 FROM a),
c AS (SELECT *, length(s1) - length(replace(s1, ',', '')) AS nc, length(s1) - length(replace(s1, '.', '')) AS nd FROM b),
e AS (SELECT *, CASE WHEN nc > 0 AND nd > 0 AND regexp_matches(s1, ',[^.]*$') THEN replace(replace(s1, '.', ''), ',', '.')
                     WHEN nc > 0 AND nd > 0 THEN replace(s1, ',', '')
                     WHEN nc > 1 THEN replace(s1, ',', '')
                     WHEN nc = 1 THEN replace(s1, ',', '.')
                     WHEN nd > 1 THEN replace(s1, '.', '')
                     ELSE s1 END AS nrm FROM c)
SELECT l_orderkey, l_linenumber, raw, {_c02} AS cleaned FROM e""")
def clean_number_locale(spark, sf):
    d = staged(table(spark, sf, "lineitem"), *CENTS, LOCALE_RAW)
    return d.select("l_orderkey", "l_linenumber", "raw", N.clean_number_locale("raw").alias("cleaned"))


# ---------------------------------------------------------------- C03 / C04 / C06
MONTHS = "CASE m WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'Mar' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' " \
         "WHEN 6 THEN 'Jun' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'Sep' WHEN 10 THEN 'Oct' " \
         "WHEN 11 THEN 'Nov' ELSE 'Dec' END"
DATE_KEYS = [["l_orderkey", "l_linenumber", "l_orderkey * 31 + l_linenumber AS k"],
             ["l_orderkey", "l_linenumber", "k", "1990 + k % 35 AS y",
              "1 + CAST((k - k % 7) / 7 AS BIGINT) % 12 AS m", "1 + CAST((k - k % 3) / 3 AS BIGINT) % 31 AS d"],
             ["l_orderkey", "l_linenumber", "k", "CAST(y AS STRING) AS ys", "lpad(CAST(m AS STRING), 2, '0') AS mm",
              "lpad(CAST(d AS STRING), 2, '0') AS dd", "CAST(m AS STRING) AS ms", "CAST(d AS STRING) AS ds",
              f"{MONTHS} AS mon"]]
DATE_RAW = ["l_orderkey", "l_linenumber", """CASE k % 10
  WHEN 0 THEN dd || '/' || mm || '/' || ys
  WHEN 1 THEN ds || '-' || ms || '-' || ys
  WHEN 2 THEN ys || '-' || mm || '-' || dd
  WHEN 3 THEN ys || '/' || mm || '/' || dd
  WHEN 4 THEN dd || '.' || mm || '.' || ys
  WHEN 5 THEN ms || '/' || ds || '/' || ys
  WHEN 6 THEN ys || mm || dd
  WHEN 7 THEN ds || ' ' || mon || ' ' || ys
  WHEN 8 THEN mon || ' ' || ds || ', ' || ys
  ELSE CASE WHEN k % 20 = 9 THEN 'n/a' ELSE NULL END END AS raw"""]

_c03 = ("CAST(CAST(coalesce(try_strptime(trim(raw), '%d/%m/%Y'), try_strptime(trim(raw), '%d-%m-%Y'), "
        "try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%Y/%m/%d'), try_strptime(trim(raw), '%d.%m.%Y')) AS DATE) AS VARCHAR)")
_c04 = ("CAST(CAST(coalesce(try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%d/%m/%Y'), "
        "try_strptime(trim(raw), '%d-%m-%Y'), try_strptime(trim(raw), '%m/%d/%Y'), try_strptime(trim(raw), '%d.%m.%Y'), "
        "try_strptime(trim(raw), '%Y%m%d'), try_strptime(trim(raw), '%d %b %Y'), try_strptime(trim(raw), '%d %B %Y'), "
        "try_strptime(trim(raw), '%b %d, %Y'), try_strptime(trim(raw), '%Y/%m/%d'), TRY_CAST(trim(raw) AS TIMESTAMP)) AS DATE) AS VARCHAR)")


@query("clean_date_multi", f"""
SELECT l_orderkey, l_linenumber, raw, {_c03} AS basic, {_c04} AS extended
FROM ({staged_sql('lineitem', *DATE_KEYS, DATE_RAW)})""")
def clean_date_multi(spark, sf):
    d = staged(table(spark, sf, "lineitem"), *DATE_KEYS, DATE_RAW)
    return d.select("l_orderkey", "l_linenumber", "raw",
                    D.clean_date_basic("raw").cast("string").alias("basic"),
                    D.clean_date_multi("raw").cast("string").alias("extended"))


DMY = ["l_orderkey", "l_linenumber", "1 + l_orderkey % 31 AS jour", "1 + l_partkey % 13 AS mois",
       "1995 + l_suppkey % 10 AS an"]


@query("merge_day_month_year", f"""
SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(printf('%04d-%02d-%02d', an, mois, jour) AS DATE) AS VARCHAR) AS date
FROM ({staged_sql('lineitem', DMY)})""")
def merge_day_month_year(spark, sf):
    d = staged(table(spark, sf, "lineitem"), DMY)
    return d.select("l_orderkey", "l_linenumber",
                    D.merge_day_month_year("jour", "mois", "an").cast("string").alias("date"))


# ---------------------------------------------------------------- C07 / C09
CAT_RAW = ["o_orderkey", """CASE o_orderkey % 10
  WHEN 0 THEN '  Terminé ' WHEN 1 THEN 'RÉGION' WHEN 2 THEN 'En Cours' WHEN 3 THEN '' WHEN 4 THEN '?'
  WHEN 5 THEN 'Inconnu' WHEN 6 THEN 'Abandonné ' WHEN 7 THEN 'NULL' WHEN 8 THEN NULL
  ELSE o_orderpriority || ' œuvre' END AS raw"""]


@query("normalize_category", f"""
SELECT o_orderkey, raw,
  CASE WHEN trim(raw) = '' THEN NULL ELSE lower(strip_accents(trim(raw))) END AS normalized,
  CASE WHEN lower(trim(raw)) IN {EMPTY} THEN NULL ELSE trim(raw) END AS empty_null
FROM ({staged_sql('orders', CAT_RAW)})""")
def normalize_category(spark, sf):
    d = staged(table(spark, sf, "orders"), CAT_RAW)
    return d.select("o_orderkey", "raw", T.normalize_category("raw").alias("normalized"),
                    T.empty_to_null("raw").alias("empty_null"))


# ---------------------------------------------------------------- C10 - C12
SEG_RAW = ["c_custkey", """CASE c_custkey % 6
  WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment)
  WHEN 2 THEN substr(c_mktsegment, 1, length(c_mktsegment) - 1)
  WHEN 3 THEN ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' '
  WHEN 4 THEN substr(c_mktsegment, 1, 3)
  ELSE c_mktsegment || 'XX' END AS raw"""]
DICT_SQL = """SELECT 'raw' AS column_name, variant, canonical, row_number() OVER (ORDER BY variant) AS ord FROM (
  SELECT DISTINCT lower(c_mktsegment) AS variant,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS canonical FROM customer)"""


def seg_dictionary(spark, sf):
    d = table(spark, sf, "customer").selectExpr(
        "lower(c_mktsegment) AS variant",
        "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS canonical").distinct()
    return d.withColumn("column", F.lit("raw"))


def _dict_oracle(fuzzy: bool) -> str:
    fz = f"""
fz AS (SELECT k, canonical AS canon FROM (
  SELECT k, canonical, row_number() OVER (PARTITION BY k ORDER BY score DESC, ord) AS rn FROM (
    SELECT vals.k, d.canonical, d.ord,
           100.0 * (1 - levenshtein(vals.k, d.variant) / greatest(length(vals.k), length(d.variant))) AS score
    FROM vals JOIN d ON true
    WHERE vals.k NOT IN (SELECT k FROM ex)) WHERE score > 80) WHERE rn = 1),""" if fuzzy else \
        "fz AS (SELECT k, canon FROM ex WHERE false),"
    return f"""
WITH d AS ({DICT_SQL}),
r AS (SELECT c_custkey, raw, trim(raw) AS v, lower(trim(raw)) AS k FROM ({staged_sql('customer', SEG_RAW)})),
vals AS (SELECT DISTINCT k FROM r WHERE k IS NOT NULL),
ex AS (SELECT k, arg_min(canonical, ord) AS canon FROM vals JOIN d ON vals.k = d.variant GROUP BY k),
{fz}
m AS (SELECT * FROM ex UNION ALL SELECT * FROM fz)
SELECT c_custkey, raw, CASE WHEN v IS NULL OR k IN {EMPTY} THEN NULL ELSE coalesce(m.canon, v) END AS corrected
FROM r LEFT JOIN m USING (k)"""


@query("dictionary_exact", _dict_oracle(False))
def dictionary_exact(spark, sf):
    d = staged(table(spark, sf, "customer"), SEG_RAW)
    out = Z.correct_exact_fuzzy(d.withColumn("corrected", F.col("raw")), "corrected",
                                seg_dictionary(spark, sf).withColumn("column", F.lit("corrected")), fuzzy=False)
    return out.select("c_custkey", "raw", "corrected")


@query("dictionary_fuzzy", _dict_oracle(True))
def dictionary_fuzzy(spark, sf):
    d = staged(table(spark, sf, "customer"), SEG_RAW)
    out = Z.correct_exact_fuzzy(d.withColumn("corrected", F.col("raw")), "corrected",
                                seg_dictionary(spark, sf).withColumn("column", F.lit("corrected")), fuzzy=True)
    return out.select("c_custkey", "raw", "corrected")


REF_SQL = """SELECT canonical, variant, row_number() OVER (ORDER BY canonical, variant) AS ord FROM (
  SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS canonical, lower(c_mktsegment) AS variant FROM customer
  UNION
  SELECT DISTINCT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), lower(substr(c_mktsegment, 1, 4)) FROM customer)"""


def ref_categories(spark, sf):
    c = table(spark, sf, "customer")
    canon = "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"
    r = c.selectExpr(f"{canon} AS canonical", "lower(c_mktsegment) AS variant").union(
        c.selectExpr(f"{canon} AS canonical", "lower(substr(c_mktsegment, 1, 4)) AS variant")).distinct()
    from pyspark.sql import Window
    return r.withColumn("ord", F.row_number().over(Window.orderBy("canonical", "variant"))).withColumn(
        "column", F.lit("strict"))


@query("reference_categories", f"""
WITH d AS ({REF_SQL}),
r AS (SELECT c_custkey, raw, trim(raw) AS v, lower(trim(raw)) AS k FROM ({staged_sql('customer', SEG_RAW)})),
vals AS (SELECT DISTINCT k FROM r WHERE k IS NOT NULL),
ct AS (SELECT k, arg_min(canonical, ord) AS canon FROM vals JOIN d ON contains(vals.k, d.variant) GROUP BY k),
fz AS (SELECT k, canonical AS canon FROM (
  SELECT k, canonical, row_number() OVER (PARTITION BY k ORDER BY score DESC, ord) AS rn FROM (
    SELECT vals.k, d.canonical, d.ord,
           100.0 * (1 - levenshtein(vals.k, d.variant) / greatest(length(vals.k), length(d.variant))) AS score
    FROM vals JOIN d ON true WHERE vals.k NOT IN (SELECT k FROM ct)) WHERE score > 80) WHERE rn = 1),
m AS (SELECT * FROM ct UNION ALL SELECT * FROM fz)
SELECT c_custkey, raw,
  CASE WHEN v IS NULL OR k IN {EMPTY} THEN NULL ELSE m.canon END AS strict,
  CASE WHEN v IS NULL OR k IN {EMPTY} THEN NULL ELSE coalesce(m.canon, v) END AS lenient
FROM r LEFT JOIN m USING (k)""")
def reference_categories(spark, sf):
    d = staged(table(spark, sf, "customer"), SEG_RAW).withColumn("strict", F.col("raw")).withColumn(
        "lenient", F.col("raw"))
    refs = ref_categories(spark, sf)
    d = Z.reference_categories(d, "strict", refs, strict=True)
    d = Z.reference_categories(d, "lenient", refs.withColumn("column", F.lit("lenient")), strict=False)
    return d.select("c_custkey", "raw", "strict", "lenient")


# ---------------------------------------------------------------- C15
SHIFT = ["o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS etat",
         """CASE o_orderkey % 5 WHEN 0 THEN 'Abandon' WHEN 1 THEN '1a' WHEN 2 THEN CAST(o_custkey AS STRING)
            WHEN 3 THEN NULL ELSE 'x' || o_orderpriority END AS note"""]


@query("realign_shifted", f"""
SELECT o_orderkey,
  CASE WHEN etat IS NULL AND regexp_matches(note, '[A-Za-z]') THEN note ELSE etat END AS etat_load,
  CASE WHEN etat IS NULL AND regexp_matches(note, '[A-Za-z]') THEN NULL ELSE note END AS note_load,
  CASE WHEN etat IS NULL AND regexp_matches(note, '^[A-Za-z]') THEN note ELSE etat END AS etat_clean,
  CASE WHEN etat IS NULL AND regexp_matches(note, '^[A-Za-z]') THEN NULL ELSE note END AS note_clean
FROM ({staged_sql('orders', SHIFT)})""")
def realign_shifted(spark, sf):
    d = staged(table(spark, sf, "orders"), SHIFT)
    load = C.realign(d, "etat", "note", "[A-Za-z]").select(
        "o_orderkey", F.col("etat").alias("etat_load"), F.col("note").alias("note_load"))
    clean = C.realign(d, "etat", "note", "^[A-Za-z]").select(
        "o_orderkey", F.col("etat").alias("etat_clean"), F.col("note").alias("note_clean"))
    return load.join(clean, "o_orderkey")


# ---------------------------------------------------------------- C16 / A19 / A20 / C17 / C18
MESSY_ORDERS = ["CAST(o_orderkey AS STRING) AS `Order ID`",
                """CASE WHEN o_orderkey % 20 = 0 THEN 'n/a'
                        WHEN o_orderkey % 20 = 1 THEN NULL
                        ELSE CAST(CAST((o_orderkey * 7919) % 1000000 AS BIGINT) AS STRING) || '.' ||
                             lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') END AS Montant""",
                """CASE o_orderstatus WHEN 'F' THEN 'Terminé' WHEN 'O' THEN ' En cours'
                        ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ABANDONNÉ' ELSE 'Abandonné' END END AS Statut""",
                """CASE WHEN o_orderkey % 25 = 0 THEN 'bientôt'
                        ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS `Date Commande`""",
                "o_orderpriority AS priorite"]
MESSY_SQL = f"(SELECT {', '.join(MESSY_ORDERS).replace('`', '\"')} FROM orders)"

_montant = f"CASE WHEN regexp_matches(replace(trim(Montant), ',', '.'), '{NUM_RE}') THEN TRY_CAST(replace(trim(Montant), ',', '.') AS DOUBLE) END"
_date = "CAST(coalesce(TRY_CAST(trim(\"Date Commande\") AS TIMESTAMP), try_strptime(trim(\"Date Commande\"), '%Y-%m-%d')) AS VARCHAR)"
_statut = "CASE WHEN trim(Statut) = '' THEN NULL ELSE lower(strip_accents(trim(Statut))) END"
_prio = "CASE WHEN trim(priorite) = '' THEN NULL ELSE lower(strip_accents(trim(priorite))) END"


def messy_orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(*MESSY_ORDERS)


def _messy_profile(spark, sf):
    d = messy_orders(spark, sf)
    rows, _ = profile_rows_df(d)
    return d, rows


def _messy_profile_df(spark, sf):
    d = messy_orders(spark, sf)
    rows, p = profile_rows_df(d)
    return d, rows, p


@query("clean_table_orders", f"""
SELECT "Order ID", {_montant} AS montant, {_statut} AS statut, {_date} AS date_commande, {_prio} AS priorite
FROM {MESSY_SQL}""")
def clean_table_orders(spark, sf):
    d, prof = _messy_profile(spark, sf)
    out = C.clean_table(d, prof)
    return out.withColumn("date_commande", F.col("date_commande").cast("string"))


@query("clean_pipeline_report", f"""
WITH b AS (SELECT count(*) AS rows_before,
             CAST(sum(("Order ID" IS NULL)::BIGINT + (Montant IS NULL)::BIGINT + (Statut IS NULL)::BIGINT
                 + ("Date Commande" IS NULL)::BIGINT + (priorite IS NULL)::BIGINT) AS BIGINT) AS nulls_before FROM {MESSY_SQL}),
a AS (SELECT count(*) AS rows_after,
             CAST(sum(("Order ID" IS NULL)::BIGINT + (montant IS NULL)::BIGINT + (statut IS NULL)::BIGINT
                 + (date_commande IS NULL)::BIGINT + (priorite IS NULL)::BIGINT) AS BIGINT) AS nulls_after FROM (
        SELECT "Order ID", {_montant} AS montant, {_statut} AS statut, {_date} AS date_commande, {_prio} AS priorite
        FROM {MESSY_SQL}))
SELECT rows_before, nulls_before, rows_after, nulls_after,
       round(100.0 * (nulls_before - nulls_after) / greatest(nulls_before, 1), 2) AS null_reduction_pct
FROM b, a""")
def clean_pipeline_report(spark, sf):
    d, prof = _messy_profile(spark, sf)
    return cleaning_report(d, C.clean_table(d, prof))


@query("anomaly_log", f"""
WITH r AS (SELECT * FROM {MESSY_SQL}),
c AS (SELECT {_montant} AS montant, {_statut} AS statut, {_prio} AS prio FROM r),
q AS (SELECT quantile_cont(montant, 0.25) AS q1, quantile_cont(montant, 0.75) AS q3 FROM c)
SELECT 'montant' AS column, 'number_lost' AS problem, count(*) FILTER (WHERE Montant IS NOT NULL AND ({_montant}) IS NULL) AS n FROM r
UNION ALL SELECT 'date_commande', 'date_lost', count(*) FILTER (WHERE "Date Commande" IS NOT NULL AND ({_date}) IS NULL) FROM r
UNION ALL SELECT 'statut', 'distinct_before', count(DISTINCT Statut) FROM r
UNION ALL SELECT 'statut', 'distinct_after', count(DISTINCT statut) FROM c
UNION ALL SELECT 'priorite', 'distinct_before', count(DISTINCT priorite) FROM r
UNION ALL SELECT 'priorite', 'distinct_after', count(DISTINCT prio) FROM c
UNION ALL SELECT 'montant', 'outliers', n FROM (
  SELECT count(*) AS n FROM c, q WHERE montant < q1 - 1.5 * (q3 - q1) OR montant > q3 + 1.5 * (q3 - q1)) WHERE n > 0""")
def anomaly_log_q(spark, sf):
    d, prof = _messy_profile(spark, sf)
    return anomaly_log(d, prof)


_k01_text = ("least(1.0, 0.5 * (1 - nulls / n) + 0.5 * least(1.0, nunique / greatest(1.0, n * 0.1)))")


def _messy_stats_sql():
    cols = ['"Order ID"', "Montant", "Statut", '"Date Commande"', "priorite"]
    names = ["Order ID", "Montant", "Statut", "Date Commande", "priorite"]
    return " UNION ALL ".join(
        f"SELECT '{nm}' AS column_name, {i} AS ordinal, count(*) AS n, count(*) - count({c}) AS nulls, "
        f"count(DISTINCT {c}) AS nunique FROM {MESSY_SQL}" for i, (c, nm) in enumerate(zip(cols, names)))


MESSY_COLS = [('"Order ID"', "string", "Order ID"), ("Montant", "string"), ("Statut", "string"),
              ('"Date Commande"', "string", "Date Commande"), ("priorite", "string")]
# proposal types / names of the messy table, as the profile decides them
_PROPOSED = ("CASE column_name WHEN 'Order ID' THEN 'order_id' WHEN 'Montant' THEN 'montant' WHEN 'Statut' THEN 'statut' "
             "WHEN 'Date Commande' THEN 'date_commande' ELSE 'priorite' END")


@query("accept_by_confidence", f"""
WITH s AS ({_messy_stats_sql()}),
k AS (SELECT column_name, {_k01_text} AS conf, {_PROPOSED} AS proposed_name FROM s)
SELECT column_name, proposed_name, round(conf, 6) AS confidence, conf >= 0.7 AS accepted,
       CASE WHEN conf >= 0.7 THEN proposed_name ELSE column_name END AS final_name,
       CASE WHEN column_name = 'priorite' THEN 'PRIORITE' ELSE proposed_name END AS overridden_name,
       CASE WHEN data_type = 'date' THEN 'text' ELSE data_type END AS overridden_type
FROM k JOIN (SELECT column_name, data_type FROM ({_profile_sql(MESSY_SQL, MESSY_COLS)})) USING (column_name)""")
def accept_by_confidence(spark, sf):
    d, _, p = _messy_profile_df(spark, sf)
    conf = column_confidence(p).select("column", "confidence_raw")
    props = p.select("column", "proposed_name", "data_type").join(conf, "column").withColumnRenamed(
        "confidence_raw", "confidence")
    acc = C.accept_proposals(props, "auto")
    # Overrides derived from the profile: category columns with a lower-case
    # name are renamed upper-case by the "user", dates become text
    ov = p.filter((F.col("data_type") == "category") & (F.col("column") == F.lower("column"))).select(
        "column", F.upper("column").alias("name"), F.lit(None).cast("string").alias("type"))
    ov = ov.unionByName(p.filter(F.col("data_type") == "date").select("column", F.lit(None).cast("string").alias("name"), F.lit("text").alias("type")))
    over = C.apply_overrides(props, ov).select("column", F.col("proposed_name").alias("overridden_name"), F.col("data_type").alias("overridden_type"))
    return acc.join(over, "column").select(
        F.col("column").alias("column_name"), "proposed_name", r6("confidence").alias("confidence"),
        "accepted", "final_name", "overridden_name", "overridden_type")


EMPTY_ROWS = ["CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS a",
              "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS b"]


@query("drop_empty_rows", f"""
SELECT 'all' AS rule, count(*) AS n, count(b) AS n_b FROM ({staged_sql('orders', EMPTY_ROWS)}) WHERE a IS NOT NULL OR b IS NOT NULL
UNION ALL
SELECT 'subset', count(*), count(b) FROM ({staged_sql('orders', EMPTY_ROWS)}) WHERE b IS NOT NULL""")
def drop_empty_rows(spark, sf):
    d = staged(table(spark, sf, "orders"), EMPTY_ROWS)
    a = C.drop_empty_rows(d).agg(F.lit("all").alias("rule"), F.count(F.lit(1)).alias("n"), F.count("b").alias("n_b"))
    s = C.drop_empty_rows(d, ["b"]).agg(F.lit("subset").alias("rule"), F.count(F.lit(1)).alias("n"),
                                         F.count("b").alias("n_b"))
    return a.unionByName(s)



# ---------------------------------------------------------------- C08
@query("clean_table_trimmed", f"""
SELECT "Order ID", {_montant} AS montant, trim(Statut) AS statut, {_date} AS date_commande, trim(priorite) AS priorite
FROM {MESSY_SQL}""")
def clean_table_trimmed(spark, sf):
    """Categories are only trimmed."""
    d, prof = _messy_profile(spark, sf)
    out = C.clean_table(d, prof, mode="trim")
    return out.withColumn("date_commande", F.col("date_commande").cast("string"))


# ---------------------------------------------------------------- C13 / C14
STRICT = ["o_orderkey",
          """CASE o_orderkey % 7 WHEN 0 THEN 'Formation Terminé' WHEN 1 THEN ' EN COURS ' WHEN 2 THEN 'inscrit' WHEN 3 THEN 'inscrot'
             WHEN 4 THEN 'zzz' WHEN 5 THEN '-' END AS statut""",
          """CASE o_orderkey % 4 WHEN 0 THEN 'expert confirmé' WHEN 1 THEN 'Expart' WHEN 2 THEN 'advanced' ELSE 'expert' END AS niveau""",
          "CASE o_orderkey % 3 WHEN 0 THEN 'expert' ELSE 'Zzz' END AS genre"]
_KNOWN = [(c, v, k) for c, vs in Z.KNOWN_CATEGORIES.items() for k, v in enumerate(vs)]


def _strict_sql(col):
    known = ", ".join(f"('{v}', lower('{v}'), {k})" for c, v, k in _KNOWN if c == col)
    return f"""SELECT o_orderkey, '{col}' AS name, (
    SELECT canonical FROM (VALUES {known}) AS k(canonical, variant, ord)
    WHERE lower(trim({col})) NOT IN {EMPTY} AND (contains(lower(trim({col})), variant)
       OR 100.0 * (1 - levenshtein(lower(trim({col})), variant) / greatest(length(lower(trim({col}))), length(variant))) > 80)
    ORDER BY contains(lower(trim({col})), variant) DESC,
      CASE WHEN contains(lower(trim({col})), variant) THEN 0 ELSE levenshtein(lower(trim({col})), variant) / greatest(length(lower(trim({col}))), length(variant)) END, ord LIMIT 1) AS value FROM s"""


@query("strict_categories", f"""
WITH s AS ({staged_sql('orders', STRICT)})
{_strict_sql('statut')} UNION ALL {_strict_sql('niveau')} UNION ALL SELECT o_orderkey, 'genre', genre FROM s""")
def strict_categories(spark, sf):
    """Columns whose name marks them strict are mapped onto the known categories; others are left alone."""
    d = staged(table(spark, sf, "orders"), STRICT)
    rows, _ = profile_rows_df(d)
    out = C.apply_dictionaries(d, rows)
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("statut", "niveau", "genre")))
    return out.select("o_orderkey", F.inline(pairs))

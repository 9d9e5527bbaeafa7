"""Registered queries: profiling, typing, naming, domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.text import qcol
from ..operators.profile import profile
from .questions import detect_domain, main_metric
from .registry import query, table, r6

NUM_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_RE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"

# driver schemas (column, family) -- fixed by the test-data contract
SCHEMAS = {
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "temporal")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "events": [("event_id", "numeric"), ("ts", "temporal"), ("user_id", "numeric"), ("event_type", "string"),
               ("value", "numeric"), ("props", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"),
                 ("s_acctbal", "numeric")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "numeric")],
    "conversations": [("conv_id", "numeric"), ("turn", "numeric"), ("role", "string"), ("text", "string")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
}

# Deterministic messy strings derived from lineitem keys (shared input text).
TYPED_STRINGS = [
    "l_orderkey", "l_linenumber",
    "CASE WHEN l_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END AS s_num",
    "CASE WHEN l_partkey % 4 = 0 THEN 'unknown' ELSE concat(CAST(2000 + l_partkey % 20 AS STRING), '-', "
    "lpad(CAST(1 + l_partkey % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + l_suppkey % 28 AS STRING), 2, '0')) END AS s_date",
    "concat('cat_', CAST(l_linenumber AS STRING)) AS s_cat",
    "concat('item ', CAST(l_orderkey AS STRING)) AS s_text",
    "CASE WHEN l_orderkey % 7 < 2 THEN concat(CAST(l_partkey AS STRING), 'x') ELSE CAST(l_partkey AS STRING) END AS s_mixed",
    "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS s_code_id",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE lpad(CAST(10000 + l_partkey % 90000 AS STRING), 5, '0') END AS code_postal",
]
TYPED_COLS = [("s_num", "string"), ("s_date", "string"), ("s_cat", "string"), ("s_text", "string"),
              ("s_mixed", "string"), ("s_code_id", "string"), ("code_postal", "string")]


def _like_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def _profile_sql(src: str, cols, guess: bool = False) -> str:
    """``cols``: (sql_identifier, family[, display_name]) per column."""
    parts = []
    for i, spec in enumerate(cols):
        c, fam = spec[0], spec[1]
        label = spec[2] if len(spec) > 2 else c
        if fam == "string":
            hits = (f"count(*) FILTER (WHERE regexp_matches({c}, '{NUM_RE}')), "
                    f"count(*) FILTER (WHERE length({c}) <= 10 AND regexp_matches({c}, '{DATE_RE}'))")
        else:
            hits = "0, 0"
        parts.append(f"SELECT '{label}' AS column_name, {i} AS ordinal, '{fam}' AS family, count(*) AS n_rows, "
                     f"count({c}) AS non_null, count(DISTINCT {c}) AS nunique, {hits} FROM {src}")
    stats = " UNION ALL ".join(parts)
    name = "lower(column_name)"
    is_id = _like_any(name, N.ID_NAME_WORDS)
    forbidden = (f"({name} IN ('id','pk','fk','row','index','jour','mois','an','annee','année') "
                 f"OR starts_with({name}, 'id_') OR ends_with({name}, '_id') "
                 f"OR {_like_any(name, ['num_acc', 'latitude', 'longitude'])} "
                 f"OR regexp_matches({name}, '(^|[_\\W])(id|pk|fk)([_\\W]|$)'))")
    sql = f"""
WITH s(column_name, ordinal, family, n_rows, non_null, nunique, num_hits, date_hits) AS ({stats}),
t AS (
  SELECT *, n_rows - non_null AS nulls,
    CASE WHEN {is_id} AND nunique >= non_null * 0.95 THEN 'id'
         WHEN non_null > 0 AND (family = 'numeric' OR (family = 'string' AND num_hits >= non_null * 0.9)) THEN 'number'
         WHEN non_null > 0 AND (family = 'temporal' OR (family = 'string' AND date_hits >= non_null * 0.7)) THEN 'date'
         WHEN nunique > 1 AND nunique < 20 THEN 'category' ELSE 'text' END AS data_type,
    {forbidden} AS forbidden,
    greatest(10, least(60, CAST(floor(n_rows * 0.1) AS BIGINT))) AS code_threshold
  FROM s),
u AS (
  SELECT *, CASE WHEN data_type = 'number' THEN 'num' WHEN data_type = 'id' AND family = 'numeric' THEN 'num'
                 WHEN data_type = 'date' THEN 'date' ELSE 'cat' END AS kind FROM t)
SELECT column_name, ordinal, n_rows, non_null, nulls, round(100.0 * nulls / greatest(n_rows, 1), 2) AS null_pct,
  nunique, data_type,
  CASE WHEN kind = 'date' THEN 'date' WHEN forbidden THEN 'forbidden' WHEN nunique <= 1 THEN 'constant'
       WHEN kind = 'num' AND nunique <= code_threshold THEN 'code' WHEN kind = 'num' THEN 'measure' ELSE 'cat' END AS role,
  code_threshold
FROM u"""
    if not guess:
        return sql
    # Guess from the name and the 5 most frequent values (ties by MD5)
    freq_parts = " UNION ALL ".join(
        f"SELECT '{spec[2] if len(spec) > 2 else spec[0]}' AS column_name, '{spec[1]}' AS family, "
        f"CAST({spec[0]} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {spec[0]} IS NOT NULL GROUP BY 1, 2, 3"
        for spec in cols)
    gname = "lower(b.column_name)"
    date_words = _like_any(gname, N.GUESS_DATE_WORDS)
    id_words = _like_any(gname, N.GUESS_ID_WORDS)
    num_words = _like_any(gname, N.GUESS_NUMBER_WORDS)
    return f"""
WITH base AS ({sql}),
f AS ({freq_parts}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, md5(v) ASC) AS rk FROM f) WHERE rk <= 5),
g AS (
  SELECT column_name, count(*) AS k,
    count(*) FILTER (WHERE regexp_matches(v, '[/\\-. ]') AND length(v) BETWEEN 4 AND 19
                       AND (regexp_matches(v, '^(\\d{{1,4}}[-/. ]\\d{{1,2}}[-/. ]\\d{{1,4}})$') OR regexp_matches(v, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})'))) AS date_like,
    count(*) FILTER (WHERE regexp_matches(v, '{NUM_RE}') AND NOT (family = 'string' AND regexp_matches(v, '^\\d{{5}}$'))) AS num_like,
    max(family) AS family
  FROM top GROUP BY column_name),
gg AS (
  SELECT b.column_name, CASE
    WHEN contains({gname}, 'code postal') OR contains({gname}, 'postal code') OR trim({gname}) = 'cp' THEN 'category'
    WHEN {date_words} THEN 'date'
    WHEN coalesce(g.k, 0) > 0 AND g.date_like >= g.k * 0.6 THEN 'date'
    WHEN coalesce(g.k, 0) > 0 AND (CASE WHEN g.family = 'numeric' THEN g.k ELSE g.num_like END) >= g.k * 0.8 THEN 'number'
    WHEN {id_words} THEN 'id'
    WHEN {num_words} THEN 'number'
    WHEN b.nunique < 15 THEN 'category' ELSE 'text' END AS guessed_type
  FROM base b LEFT JOIN g ON b.column_name = g.column_name)
SELECT base.*, gg.guessed_type, gg.guessed_type <> base.data_type AS type_corrected
FROM base JOIN gg USING (column_name)"""


def _samples_sql(src: str, cols) -> str:
    """The five most frequent values (ties by MD5), as one MD5 a column."""
    counts = " UNION ALL ".join(f"SELECT '{spec[0]}' AS column_name, CAST({spec[0]} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {spec[0]} IS NOT NULL GROUP BY 2" for spec in cols)
    return f"""SELECT column_name, md5(string_agg(v, chr(1) ORDER BY n DESC, md5(v))) AS samples_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, md5(v)) AS rk FROM ({counts})) WHERE rk <= 5 GROUP BY column_name"""


def _with_samples_sql(src: str, cols) -> str:
    return f"SELECT p.*, s.samples_md5 FROM ({_profile_sql(src, cols)}) p LEFT JOIN ({_samples_sql(src, cols)}) s USING (column_name)"


PROFILE_COLS = ["column_name", "ordinal", "n_rows", "non_null", "nulls", "null_pct", "nunique", "data_type",
                "role", "code_threshold"]


def _profile_out(p, guess=False, samples=False):
    cols = [F.col("column").alias("column_name"), "ordinal", "n_rows", F.col("non_null").cast("long"),
            F.col("nulls").cast("long"), "null_pct", F.col("nunique").cast("long"), "data_type", "role",
            F.col("code_threshold").cast("long")]
    if guess:
        cols += ["guessed_type", "type_corrected"]
    if samples:
        cols.append(F.when(F.size("samples") > 0, F.md5(F.concat_ws("\x01", "samples"))).alias("samples_md5"))
    return p.select(*cols)


for _t in ["orders", "lineitem", "customer", "part", "events", "supplier", "documents", "conversations", "labels"]:
    def _mk(t):
        @query(f"profile_{t}", _with_samples_sql(t, SCHEMAS[t]))
        def _q(spark, sf):
            return _profile_out(profile(table(spark, sf, t)), samples=True)
        return _q
    _mk(_t)


@query("type_dirty_strings", _profile_sql(f"(SELECT {', '.join(TYPED_STRINGS)} FROM lineitem)",
                                          TYPED_COLS, guess=True))
def type_dirty_strings(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr(*TYPED_STRINGS)
    cols = [c for c, _ in TYPED_COLS]
    return _profile_out(profile(d, cols), guess=True)


# ---------------------------------------------------------------- P02 / P09 / P10
ID_TABLES = ["customer", "supplier", "part", "orders", "events"]


def _id_sql():
    parts = []
    for t in ID_TABLES:
        for c, _ in SCHEMAS[t]:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS non_null, "
                         f"count(DISTINCT {c}) AS nunique FROM {t}")
    name = "lower(column_name)"
    return f"""
WITH s AS ({' UNION ALL '.join(parts)})
SELECT table_name, column_name,
  {_like_any(name, N.ID_NAME_WORDS)} AND nunique >= non_null * 0.95 AS is_id,
  ({name} IN ('id','index','uuid') OR starts_with({name}, 'id_') OR ends_with({name}, '_id')
   OR contains({name}, 'identifiant') OR contains({name}, 'num_acc') OR starts_with({name}, 'num_')
   OR (non_null >= 3 AND nunique / non_null >= 0.995)) AS identifier_like,
  ({name} IN ('id','pk','fk','row','index','jour','mois','an','annee','année') OR starts_with({name}, 'id_')
   OR ends_with({name}, '_id') OR contains({name}, 'num_acc') OR contains({name}, 'latitude')
   OR contains({name}, 'longitude') OR regexp_matches({name}, '(^|[_\\W])(id|pk|fk)([_\\W]|$)')) AS forbidden
FROM s"""


@query("id_like_columns", _id_sql())
def id_like_columns(spark, sf):
    out = None
    for t in ID_TABLES:
        p = profile(table(spark, sf, t)).select(
            F.lit(t).alias("table_name"), F.col("column").alias("column_name"),
            (F.col("data_type") == "id").alias("is_id"),
            (N.identifier_name(F.col("column"))
             | ((F.col("non_null") >= 3) & (F.col("nunique") / F.col("non_null") >= 0.995))).alias("identifier_like"),
            F.col("forbidden"))
        out = p if out is None else out.unionByName(p)
    return out


@query("codes_vs_measures", f"""
SELECT column_name, nunique, code_threshold, role FROM ({_profile_sql('lineitem', SCHEMAS['lineitem'])})
WHERE data_type IN ('number', 'id')
UNION ALL
SELECT column_name, nunique, code_threshold, role FROM ({_profile_sql('part', SCHEMAS['part'])})
WHERE data_type IN ('number', 'id')""")
def codes_vs_measures(spark, sf):
    out = None
    for t in ["lineitem", "part"]:
        p = profile(table(spark, sf, t)).filter(F.col("data_type").isin("number", "id")).select(
            F.col("column").alias("column_name"), F.col("nunique").cast("long"),
            F.col("code_threshold").cast("long"), "role")
        out = p if out is None else out.unionByName(p)
    return out


# ---------------------------------------------------------------- P06 / P07 / P12
ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]

# column names of every driver table (the test-data contract, FIXTURES.md); the
# oracles read the catalog from here, the Spark side from the real schemas
ALL_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    **{t: [c for c, _ in SCHEMAS[t]] for t in ["customer", "supplier", "part", "orders", "lineitem", "events",
                                               "documents", "labels", "conversations"]},
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
}
CATALOG_SQL = "(VALUES " + ", ".join(
    f"('{t}', '{c}', {i + 1})" for t in ALL_TABLES for i, c in enumerate(ALL_COLUMNS[t])
) + ") AS cat(table_name, column_name, ordinal_position)"


def name_catalog(spark, sf):
    """(table, column, ordinal) of every driver table, plus distinct label
    values of a few text columns used as candidate names."""
    rows = []
    for t in ALL_TABLES:
        for i, c in enumerate(table(spark, sf, t).columns):
            rows.append((t, c, i + 1))
    cat = spark.createDataFrame(rows, "table_name string, name string, ordinal int")
    labels = (table(spark, sf, "part").select(F.lit("part.p_name").alias("table_name"), F.col("p_name").alias("name"))
              .union(table(spark, sf, "orders").select(F.lit("orders.o_orderpriority"), "o_orderpriority"))
              .union(table(spark, sf, "customer").select(F.lit("customer.c_mktsegment"), "c_mktsegment"))
              .distinct().withColumn("ordinal", F.lit(0)))
    return cat.unionByName(labels)


NAME_SOURCE_SQL = f"""
SELECT table_name, column_name AS name, ordinal_position AS ordinal FROM {CATALOG_SQL}
UNION ALL SELECT DISTINCT 'part.p_name', p_name, 0 FROM part
UNION ALL SELECT DISTINCT 'orders.o_orderpriority', o_orderpriority, 0 FROM orders
UNION ALL SELECT DISTINCT 'customer.c_mktsegment', c_mktsegment, 0 FROM customer"""


def _snake_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    s = f"lower(strip_accents({s}))"
    s = f"regexp_replace({s}, '[\\s\\-]+', '_', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9_]', '', 'g')"
    cases = " ".join(f"WHEN regexp_full_match(s1, '{p}') THEN '{r}'" for p, r in N.RENAME_RULES)
    return f"trim(regexp_replace(CASE {cases} ELSE s1 END, '__+', '_', 'g'), '_')", s


def _suggest_sql(x: str) -> str:
    low = f"lower(trim({x}))"
    exact = " ".join(f"WHEN {low} = '{a}' THEN '{b}'" for a, b in N.SUGGESTIONS)
    part = " ".join(f"WHEN contains({low}, '{a}') THEN '{b}'" for a, b in N.SUGGESTIONS)
    return (f"CASE {exact} {part} WHEN length({low}) <= 4 AND regexp_full_match({low}, '\\p{{L}}+') "
            f"THEN upper(substr({low}, 1, 1)) || substr({low}, 2) ELSE {x} END")


_snake_final, _snake_s1 = _snake_sql("name")


@query("names_snake_case", f"""
SELECT table_name, name, {_snake_final} AS proposed_name
FROM (SELECT *, {_snake_s1} AS s1 FROM ({NAME_SOURCE_SQL}))""")
def names_snake_case(spark, sf):
    c = name_catalog(spark, sf)
    return c.select("table_name", "name", N.snake_case(F.col("name")).alias("proposed_name"))


@query("names_suggested", f"""
SELECT table_name, name, {_suggest_sql('name')} AS suggested FROM ({NAME_SOURCE_SQL})""")
def names_suggested(spark, sf):
    c = name_catalog(spark, sf)
    return c.select("table_name", "name", N.suggest_name(F.col("name")).alias("suggested"))


# would-be column names: the parts of a brand and size, many of which are renamed alike
PART_NAMES = "concat(CASE p_partkey % 4 WHEN 0 THEN 'Montant' WHEN 1 THEN 'montant_2' WHEN 2 THEN p_name ELSE p_type END, '')"


@query("names_deduplicated", f"""
WITH RECURSIVE p AS (SELECT p_brand, p_size, p_partkey, {_snake_final} AS proposed FROM
  (SELECT *, {_snake_s1} AS s1 FROM (SELECT p_brand, p_size, p_partkey, {PART_NAMES} AS name FROM part))),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k, list(proposed) OVER (PARTITION BY p_brand, p_size) AS wanted FROM p),
f AS (
  SELECT p_brand, p_size, CAST(NULL AS BIGINT) AS p_partkey, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS final_name, CAST([] AS VARCHAR[]) AS given FROM (SELECT DISTINCT p_brand, p_size FROM p)
  UNION ALL
  SELECT p_brand, p_size, p_partkey, k, final_name, list_append(given, final_name) FROM (
    SELECT n.p_brand, n.p_size, n.p_partkey, n.k, f.given, CASE WHEN list_contains(f.given, n.proposed) THEN
        list_filter(list_transform(range(2, len(n.wanted) + 3), lambda i: n.proposed || '_' || i), lambda c: NOT list_contains(f.given, c) AND NOT list_contains(n.wanted, c))[1]
      ELSE n.proposed END AS final_name
    FROM f JOIN n ON n.p_brand = f.p_brand AND n.p_size = f.p_size AND n.k = f.k + 1))
SELECT p_partkey, final_name FROM f WHERE k > 0""")
def names_deduplicated(spark, sf):
    """P06 on rows: the parts of a brand and size stand for the columns of a table."""
    c = table(spark, sf, "part").selectExpr("p_partkey", "p_brand", "p_size", f"{PART_NAMES} AS name").withColumn("proposed", N.snake_case(F.col("name")))
    return N.dedupe_names(c, "proposed", "p_partkey", ["p_brand", "p_size"]).select("p_partkey", "final_name")


def _domain_sql():
    names = "string_agg(lower(column_name), ' ' ORDER BY ordinal_position)"
    from .questions import DOMAIN_WORDS
    cases = " ".join(f"WHEN {_like_any('names', w)} THEN '{d}'" for d, w in DOMAIN_WORDS)
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i + 1} AS ordinal_position, count(*) AS n_rows, count({c}) AS held FROM {t}"
                                for t in ALL_TABLES for i, c in enumerate(ALL_COLUMNS[t]))
    return f"""
SELECT table_name, names, n_rows, held, CASE {cases} ELSE 'generic' END AS domain FROM (
  SELECT table_name, max(n_rows) AS n_rows, CAST(sum(held) AS BIGINT) AS held, {names} AS names FROM ({counts}) GROUP BY table_name)"""


@query("domain_of_tables", _domain_sql())
def domain_of_tables(spark, sf):
    """P12 over a catalogue made from the tables' rows: each column with its rows and non-null values."""
    parts = []
    for t in ALL_TABLES:
        df = table(spark, sf, t)
        columns = F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column"), F.lit(i + 1).alias("ordinal"), F.col("_rows").alias("n_rows"), F.col(f"_held{i}").alias("held"))
                            for i, c in enumerate(df.columns)))
        parts.append(df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(qcol(c)).alias(f"_held{i}") for i, c in enumerate(df.columns))).select(F.inline(columns)))
    cat = reduce(DataFrame.union, parts)
    sizes = cat.groupBy("table_name").agg(F.max("n_rows").alias("n_rows"), F.sum("held").alias("held"))
    return detect_domain(cat, "table_name", "column", "ordinal").join(sizes, "table_name")


# ---------------------------------------------------------------- P13 / S08
MM_COLS = ["o_totalprice", "c_acctbal", "o_custkey"]


@query("main_metric", """
WITH j AS (SELECT o.o_totalprice, c.c_acctbal, o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT 'o_totalprice' AS column_name, stddev_samp(o_totalprice) AS sd FROM j
      UNION ALL SELECT 'c_acctbal', stddev_samp(c_acctbal) FROM j
      UNION ALL SELECT 'o_custkey', stddev_samp(o_custkey) FROM j)
SELECT column_name, round(sd, 6) AS std FROM s ORDER BY sd DESC LIMIT 1""")
def main_metric_q(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    j = o.join(c, "o_custkey").select(*MM_COLS)
    best = main_metric(j, MM_COLS)
    return j.agg(r6(F.stddev_samp(F.col(best).cast("double"))).alias("std")).select(
        F.lit(best).alias("column_name"), "std")


@query("dataset_summary", """
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
  CAST(sum((o_orderkey IS NULL)::BIGINT + (o_custkey IS NULL)::BIGINT + (o_orderstatus IS NULL)::BIGINT
      + (o_totalprice IS NULL)::BIGINT + (o_orderdate IS NULL)::BIGINT + (o_orderpriority IS NULL)::BIGINT) AS BIGINT) AS null_cells
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
      FROM orders)""")
def dataset_summary_q(spark, sf):
    from ..operators.profile import dataset_summary
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice", "o_orderdate",
        "o_orderpriority")
    return dataset_summary(o)


"""Registered queries: question plans of many tables (P12, P14, P15, Q01-Q03) and routing of question lists (Q08).

The oracles share the fixed word lists and texts; the evaluation of the rules is written anew in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.profile import profile
from . import dispatch as DP
from . import questions as Q
from .q_profile import SCHEMAS, _like_any, _profile_sql
from .registry import query, table

# one table a domain, made from the given tables under names of that domain: (source, [(expression, name, family)])
DOMAIN_TABLES = {
    "accident_sheet": ("lineitem", [
        ("l_orderkey", "num_acc", "numeric"), ("l_linenumber", "code_lum", "numeric"), ("l_partkey % 5", "code_collision", "numeric"), ("l_orderkey % 2", "agglo", "numeric"),
        ("CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 END", "atm", "numeric"), ("l_partkey % 9", "intersection", "numeric"), ("l_extendedprice", "cout", "numeric"), ("l_partkey", "distance", "numeric"),
        ("l_suppkey % 24", "heure", "numeric"), ("dayofweek(l_shipdate)", "jour_semaine", "numeric"), ("month(l_shipdate)", "mois_accident", "numeric")]),
    "course_log": ("events", [
        ("event_id", "apprenant", "numeric"), ("event_type", "statut", "string"), ("user_id % 40", "taux_completion", "numeric"), ("value", "score_final", "numeric"),
        ("concat('m', CAST(user_id % 8 AS STRING))", "module", "string"), ("event_id % 300", "jours_inactivite", "numeric")]),
    "sales_sheet": ("orders", [
        ("o_totalprice", "revenue", "numeric"), ("o_orderpriority", "customer_segment", "string"), ("o_orderstatus", "product_category", "string"), ("o_custkey % 50", "quantity", "numeric"),
        ("o_custkey % 11", "discount", "numeric"), ("concat('r', CAST(o_custkey % 5 AS STRING))", "region", "string"), ("o_orderdate", "date_vente", "temporal")]),
    "staff": ("customer", [
        ("c_mktsegment", "departement", "string"), ("c_acctbal", "salaire", "numeric"), ("c_custkey % 7", "anciennete_ans", "numeric"), ("c_nationkey", "turnover", "numeric"),
        ("concat('n', CAST(c_custkey % 4 AS STRING))", "niveau", "string"), ("c_custkey % 97", "performance", "numeric")]),
    "staff_codes": ("customer", [("c_custkey % 3", "u", "numeric"), ("c_custkey % 4", "v", "numeric"), ("'one'", "w", "string")]),
    "event_log": ("events", [(c, c, f) for c, f in SCHEMAS["events"]]),
    "rh_keys": ("customer", [("c_custkey", "rh_id", "numeric"), ("c_name", "libelle", "string")]),
}
SALES_SQL = """(SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice AS revenue, o.o_orderdate, o.o_orderpriority, c.c_acctbal, c.c_mktsegment, r.r_name AS region
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""
SALES_COLUMNS = [("o_orderkey", "numeric"), ("o_orderstatus", "string"), ("revenue", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string"), ("region", "string")]


def sales(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return (o.join(c, "o_custkey").join(n, "c_nationkey").join(r, "n_regionkey")
            .select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("revenue"), "o_orderdate", "o_orderpriority",
                    "c_acctbal", "c_mktsegment", F.col("r_name").alias("region")))


def domain_table(spark, sf, name):
    source, columns = DOMAIN_TABLES[name]
    return table(spark, sf, source).selectExpr(*(f"{e} AS `{c}`" for e, c, _ in columns))


def _domain_sources():
    return {t: (f"(SELECT {', '.join(f'{e} AS {c}' for e, c, _ in columns)} FROM {source})", [(c, f) for _, c, f in columns]) for t, (source, columns) in DOMAIN_TABLES.items()}


def _text(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _values(rows) -> str:
    def one(v):
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else _text(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _catalogue_sql(sources) -> str:
    """(t, ord, col, role, data_type, nunique, nulls) of each source (sql, columns)."""
    return " UNION ALL ".join(f"SELECT '{t}' AS t, ordinal AS ord, column_name AS col, role, data_type, nunique, nulls FROM ({_profile_sql(src, cols)})" for t, (src, cols) in sources.items())


def _domains_sql() -> str:
    cases = " ".join(f"WHEN {_like_any('names', w)} THEN '{d}'" for d, w in Q.DOMAIN_WORDS)
    return f"SELECT t, CASE {cases} ELSE 'generic' END AS domain FROM (SELECT t, string_agg(lower(col), ' ' ORDER BY ord) AS names FROM cat GROUP BY t)"


def plan_sql(sources, limit: int = 10) -> str:
    named = [(f"{d}: {p}", where, "|".join(words), 1) for d, parts in Q.PARTS.items() for p, (where, words) in parts.items()]
    parts = named + [(p, where, "", k) for p, (where, k) in Q.PLACES.items()]
    rules = []
    for d, asked in Q.RULES.items():
        for slot, (shape, needs, more) in enumerate(asked):
            for at, p in enumerate(needs):
                limits = (more.get("most"), more.get("least")) if at == 0 else (None, None)
                rules.append((d, slot, shape, len(needs), at, p if p in Q.PLACES else f"{d}: {p}", *limits, more.get("with_null", False), more.get("unless")))
    shapes = [(n, c, "".join(f"{{{x}}}" if isinstance(x, int) else x for x in words), kind) for n, (c, words, kind) in Q.SHAPES.items()]
    purposes = [(t, k, Q.purpose(t, k)) for t in Q.THEMES for k in range(1, 7)]
    member = lambda name, rank, where: f"SELECT *, '{name}' AS list, {rank} AS pr FROM cat WHERE {where}"
    code_last = "CASE role WHEN 'code' THEN 1 ELSE 0 END"
    members = " UNION ALL ".join([
        member("columns", 0, "true"), member("varied", 0, "nunique > 1"), member("measures", 0, "role = 'measure'"), member("codes", 0, "role = 'code'"), member("dates", 0, "role = 'date'"),
        member("numbers", code_last, "role IN ('measure', 'code')"), member("categories", code_last, "role IN ('cat', 'code')"), member("small", code_last, f"role IN ('cat', 'code') AND nunique <= {Q.SMALL}"),
        member("leading", f"CASE WHEN nunique > {Q.SMALL} THEN 2 ELSE 0 END + {code_last}", "role IN ('cat', 'code')"),
        member("any", "CASE role WHEN 'code' THEN 0 WHEN 'measure' THEN 1 ELSE 2 END", "role IN ('code', 'measure', 'cat')")])
    return f"""
WITH cat AS ({_catalogue_sql(sources)}),
dom AS ({_domains_sql()}),
parts(part, list, words, k) AS ({_values(parts)}),
rules(rules, slot, shape, needs, place, part, most, least, with_null, unless_part) AS ({_values(rules)}),
shapes(shape, chart, template, kind) AS ({_values(shapes)}),
purposes(theme, kind, purpose) AS ({_values(purposes)}),
members AS ({members}),
picks AS (SELECT t, part, col, nunique, nunique + (nulls > 0)::INTEGER AS seen FROM (
  SELECT m.*, p.part, p.k, row_number() OVER (PARTITION BY m.t, p.part ORDER BY m.pr, m.ord) AS rn
  FROM members m JOIN parts p ON p.list = m.list AND (p.words = '' OR regexp_matches(lower(m.col), p.words))) WHERE rn = k),
levels AS (SELECT t, domain, 0 AS level, domain AS rules FROM dom UNION ALL SELECT t, domain, 1, 'generic' FROM dom UNION ALL SELECT t, domain, 2, 'any table' FROM dom),
have AS (SELECT l.t, l.domain, l.level, r.slot, r.shape, r.needs, r.place, p.col
  FROM levels l JOIN rules r ON r.rules = l.rules JOIN picks p ON p.t = l.t AND p.part = r.part LEFT JOIN picks x ON x.t = l.t AND x.part = r.unless_part
  WHERE x.part IS NULL AND (r.most IS NULL OR CASE WHEN r.with_null THEN p.seen ELSE p.nunique END <= CAST(r.most AS BIGINT))
    AND (r.least IS NULL OR CASE WHEN r.with_null THEN p.seen ELSE p.nunique END >= CAST(r.least AS BIGINT))),
whole AS (SELECT t, domain, level, slot, shape, list(col ORDER BY place) AS cols FROM have GROUP BY t, domain, level, slot, shape, needs HAVING count(*) = needs),
once AS (SELECT * FROM (SELECT w.*, s.chart, s.template, s.kind, row_number() OVER (PARTITION BY t, level, list_sort(cols), s.chart ORDER BY slot) AS rn FROM whole w JOIN shapes s USING (shape)) WHERE rn = 1),
best AS (SELECT * FROM (SELECT *, min(level) OVER (PARTITION BY t) AS lowest FROM once) WHERE level = lowest),
numbered AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY slot) AS qid FROM best)
SELECT n.t AS table_name, n.domain, CAST(n.qid AS INTEGER) AS qid, replace(replace(n.template, '{{1}}', n.cols[1]), '{{2}}', coalesce(n.cols[2], '')) AS question,
       array_to_string(n.cols, ',') AS columns, n.chart, p.purpose
FROM numbered n JOIN purposes p ON p.theme = n.domain AND p.kind = n.kind WHERE n.qid <= {limit}"""


@query("question_plans_by_domain", plan_sql(_domain_sources()))
def question_plans_by_domain(spark, sf):
    """Q01 / Q02 for a catalogue of tables, one or more a domain, profiled from their rows."""
    catalogue = Q.catalogue_of({t: profile(domain_table(spark, sf, t)) for t in DOMAIN_TABLES})
    found = Q.plan_catalogue(catalogue)
    return found.select(F.col("table").alias("table_name"), "domain", "qid", "question", F.concat_ws(",", "columns").alias("columns"), "chart", "purpose")


@query("question_plan", f"SELECT qid, question, columns, chart, purpose FROM ({plan_sql({'sales': (SALES_SQL, SALES_COLUMNS)})})")
def question_plan(spark, sf):
    qs = Q.plan_questions(profile(sales(spark, sf)).collect())
    return Q.questions_df(spark, qs).select("qid", "question", F.concat_ws(",", "columns").alias("columns"), "chart", "purpose")


# ---------------------------------------------------------------- P14 / P15
DIMENSION_TABLES = {"sales": (SALES_SQL, SALES_COLUMNS), **{t: _domain_sources()[t] for t in ("sales_sheet", "staff", "course_log", "event_log")}}


def _last_pattern_sql(words) -> str:
    return "coalesce(" + ", ".join(f"first(col ORDER BY ord) FILTER (contains(lower(col), '{w}'))" for w in reversed(words)) + ")"


def _numeric(t: str) -> str:
    return ", ".join(f"'{c}'" for c, f in DIMENSION_TABLES[t][1] if f == "numeric")


@query("main_dimensions", f"""
WITH cat AS ({_catalogue_sql(DIMENSION_TABLES)}),
kinds AS (SELECT *, data_type = 'number' OR (data_type = 'id' AND ({' OR '.join(f"(t = '{t}' AND col IN ({_numeric(t)}))" for t in DIMENSION_TABLES)})) AS num FROM cat),
cats AS (SELECT * FROM kinds WHERE NOT num AND data_type <> 'date' AND nunique > 1),
dims AS (SELECT t, {_last_pattern_sql(Q.SEGMENT_WORDS)} AS segment, {_last_pattern_sql(Q.REGION_WORDS)} AS region, count(*) AS n FROM cats GROUP BY t),
others AS (SELECT c.t, first(c.col ORDER BY c.ord) AS other FROM cats c JOIN dims d USING (t)
  WHERE d.n > 2 AND c.nunique < 20 AND c.col IS DISTINCT FROM d.segment AND c.col IS DISTINCT FROM d.region GROUP BY c.t),
small AS (SELECT t, string_agg(col, ',' ORDER BY ord) AS low_cardinality FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY ord) AS rn FROM kinds WHERE num AND nunique <= 500
    AND NOT contains(lower(col), 'date_jour') AND NOT contains(lower(col), 'date_mois') AND NOT contains(lower(col), 'date_an') AND NOT contains(lower(col), 'num_acc')) WHERE rn <= 3 GROUP BY t)
SELECT tt.t AS table_name, d.segment, d.region, o.other, s.low_cardinality
FROM (SELECT DISTINCT t FROM cat) tt LEFT JOIN dims d USING (t) LEFT JOIN others o USING (t) LEFT JOIN small s USING (t)""")
def main_dimensions(spark, sf):
    """P14 and P15 of several tables, from profiles of their rows (one row a table here)."""
    out = []
    for t in DIMENSION_TABLES:
        prof = profile(sales(spark, sf) if t == "sales" else domain_table(spark, sf, t)).collect()
        d = Q.dimensions(prof)
        out.append((t, d["segment"], d["region"], d["other"], ",".join(Q.low_cardinality_numeric(prof)) or None))
    return spark.createDataFrame(out, "table_name string, segment string, region string, other string, low_cardinality string")


# ---------------------------------------------------------------- Q08
def _first_match_sql(x, table_, default):
    cases = " ".join(f"WHEN {' OR '.join(f'contains({x}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'"
                     for name, words in table_)
    return f"CASE {cases} ELSE '{default}' END"


_NUM, _CAT = "['o_orderkey', 'o_custkey', 'o_totalprice']", "['o_orderstatus', 'o_orderpriority']"
_new = lambda xs: f"coalesce(list_filter({xs}, lambda c: NOT list_contains(f.used, c))[1], {xs}[1])"


@query("question_route", f"""
WITH RECURSIVE r AS (SELECT conv_id, turn, {_first_match_sql('lower(text)', Q.ROUTE_WORDS, 'histogram')} AS route,
                       row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
f AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS route, CAST([] AS VARCHAR[]) AS cols FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, k, list_concat(used, cols), turn, route, cols FROM (
    SELECT f.conv_id, r.k, f.used, CAST(r.turn AS BIGINT) AS turn, r.route,
      CASE r.route WHEN 'correlation_matrix' THEN [] WHEN 'category_distribution' THEN [{_new(_CAT)}]
                   WHEN 'mean_by_category' THEN [{_new(_CAT)}, {_new(_NUM)}] ELSE [{_new(_NUM)}] END AS cols
    FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.k = f.k + 1 WHERE r.k <= 20))
SELECT conv_id, turn, route, array_to_string(cols, ',') AS columns FROM f WHERE k > 0""")
def question_route(spark, sf):
    """Every conversation is a list of questions about orders."""
    kinds = DP.kinds_of(profile(table(spark, sf, "orders")).collect())
    found = Q.route_questions(table(spark, sf, "conversations"), "text", ["conv_id"], ["turn"], kinds)
    return found.select("conv_id", F.col("turn").cast("long").alias("turn"), "route", F.concat_ws(",", "columns").alias("columns"))

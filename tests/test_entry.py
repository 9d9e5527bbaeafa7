"""Driver contract: entry(), queries() and oracle_sql() on the small tables."""

import duckdb

import __spark_entry__ as E
from tabulo.plans import registry

from .conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["c_mktsegment", "mean_totalprice", "n_orders"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_oracles_match_at_small_scale(spark):
    """Every query against its DuckDB oracle on sf0.001 (row count + sorted values)."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for name, sql in sorted(sqls.items()):
        df = qs[name](spark, SF_SMALL)
        s_rows = df.collect()
        res = con.execute(sql)
        d_cols = [d[0] for d in res.description]
        d_rows = res.fetchall()
        if sorted(df.columns) != sorted(d_cols) or len(s_rows) != len(d_rows):
            bad.append(name)
            continue

        def canon(rows, cols):
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            out = []
            for r in rows:
                vals = []
                for i in order:
                    v = r[i]
                    if isinstance(v, float):
                        v = round(v, 6)
                    elif hasattr(v, "isoformat"):
                        v = v.isoformat()
                    elif v is not None and not isinstance(v, (int, str, bool)):
                        v = str(v)
                    vals.append(v)
                out.append(tuple(vals))
            return sorted(out, key=repr)

        if canon(s_rows, df.columns) != canon(d_rows, d_cols):
            bad.append(name)
    assert not bad, bad


def test_rows_only_queries_run(spark):
    """Queries without an SQL oracle still run on the small tables and keep their invariants."""
    qs, sqls = E.queries(), E.oracle_sql()
    rows_only = sorted(set(registry.QUERIES) - set(sqls))
    assert rows_only == []
    sample = qs["bounded_sample"](spark, SF_SMALL)
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert sample.count() == min(1000, orders.count())
    again = qs["bounded_sample"](spark, SF_SMALL)
    assert sorted(r[0] for r in sample.select("o_orderkey").collect()) == \
        sorted(r[0] for r in again.select("o_orderkey").collect())          # deterministic
    dash = qs["auto_analyze"](spark, SF_SMALL)
    charts = {r["chart"] for r in dash.select("chart").distinct().collect()}
    assert {"histogram", "box", "bar"} <= charts
    assert dash.select("qid").distinct().count() <= 15

"""Operators on tiny fixtures (FIXTURES.md X1, X9, X11, X13, X14) and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from tabulo.operators import agg as A
from tabulo.operators import confidence as K
from tabulo.operators import fuzzy as Z
from tabulo.operators import series as S
from tabulo.operators import stats as ST
from tabulo.operators.freq import freq
from tabulo.operators.profile import profile, dataset_summary
from tabulo.plans import questions as Q
from tabulo.sources import html as H


@pytest.fixture(scope="module")
def x1(spark):
    rows = [(25.0, "Alice", 85.5), (30.0, "Bob", 90.0), (35.0, "Charlie", None), (None, "David", 78.5),
            (40.0, "Eve", 92.0)]
    return spark.createDataFrame(rows, "age double, nom string, score double")


def test_profile_and_confidence_x1(x1):
    p = profile(x1)
    rows = {r["column"]: r for r in p.collect()}
    assert rows["age"]["nulls"] == 1 and rows["age"]["nunique"] == 4
    assert rows["nom"]["nunique"] == 5
    assert math.isclose(rows["age"]["std"], 6.454972, rel_tol=1e-6)
    cc = {r["column"]: r for r in K.column_confidence(p).collect()}
    assert math.isclose(cc["age"]["confidence_raw"], 0.449654, abs_tol=1e-6)
    assert math.isclose(cc["nom"]["confidence_raw"], 1.0)
    assert math.isclose(cc["score"]["confidence_raw"], 0.417301, abs_tol=1e-6)
    assert cc["nom"]["bar"] == "█████" and cc["age"]["bar"] == "██░░░"
    qs = x1.sparkSession.createDataFrame([(1, ["age", "score"]), (2, []), (3, ["unknown"])],
                                         "qid int, columns array<string>")
    q = {r["qid"]: r for r in K.question_confidence(qs, K.column_confidence(p)).collect()}
    assert q[1]["overall"] == 0.48 and q[1]["data_quality"] == "weak"
    assert q[1]["completeness"] == 0.8 and q[1]["variability"] == 0.13
    assert q[2]["overall"] == 0.0 and q[2]["data_quality"] == "no column"
    assert q[3]["overall"] == 0.0 and q[3]["data_quality"] == "columns not found"


def test_all_null_numeric_confidence(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    cc = K.column_confidence(profile(df)).collect()[0]
    assert math.isclose(cc["confidence_raw"], 0.3)


def test_freq_invariants(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.0), (2, "a", None)], "k int, s string, d double")
    ft = freq(df)
    per = {r["column"]: r["total"] for r in ft.groupBy("column").agg(F.sum("n").alias("total")).collect()}
    assert per == {"k": 3, "s": 3, "d": 3}
    d_null = ft.filter("column = 'd' AND key IS NULL").collect()[0]["n"]
    assert d_null == 2  # NaN is NULL


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "a string, b double")
    p = profile(empty).collect()
    assert [r["n_rows"] for r in p] == [0, 0]
    assert dataset_summary(empty).collect()[0]["rows"] == 0
    const = spark.createDataFrame([("x", 1.0)] * 4, "a string, b double")
    roles = {r["column"]: r["role"] for r in profile(const).collect()}
    assert roles == {"a": "constant", "b": "constant"}


def test_partition_independence(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = sorted(tuple(r) for r in profile(df).select("column", "nunique", "nulls", "data_type").collect())
    b = sorted(tuple(r) for r in profile(df.repartition(5).orderBy(F.rand(7))).select(
        "column", "nunique", "nulls", "data_type").collect())
    assert a == b


def test_box_and_trend_x11(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "v double")
    b = ST.boxplot_stats(df, "v").collect()[0]
    assert (b["q1"], b["q3"], b["lower_fence"], b["upper_fence"], b["n_outliers"]) == (2.0, 4.0, -1.0, 7.0, 1)
    assert math.isclose(b["std"], 43.617657, rel_tol=1e-6) and b["mean"] == 22.0
    o = ST.iqr_outliers(df, ["v"]).collect()[0]
    assert o["n_outliers"] == 1 and list(o["examples"]) == [100.0]
    t = spark.createDataFrame([(1.0, 2.0), (2.0, 3.5), (4.0, 9.0), (None, 1.0)], "x double, y double")
    s, line = ST.linear_trend(t, "x", "y")
    s = s.collect()[0]
    assert math.isclose(s["slope"], 2.392857, rel_tol=1e-6) and math.isclose(s["intercept"], -0.75)
    assert math.isclose(s["r"], 0.991749, rel_tol=1e-6) and s["n"] == 3
    assert line.count() == 100
    z = spark.createDataFrame([(1.0, 2.0), (1.0, 3.5)], "x double, y double")
    zs = ST.correlation_matrix(z, ["x", "y"]).collect()[0]
    assert zs["r"] is None  # no exception under ANSI


def test_rolling_x11_and_chunked_plan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 13)], "v double").withColumn("o", F.col("v"))
    r = S.rolling(df, "o", "v", smooth_above=0, band_above=0).orderBy("row_idx").collect()
    assert r[-1]["rolling_mean"] == 7.5 and r[9]["rolling_mean"] == 5.5 and r[0]["rolling_mean"] == 1.0
    assert r[-1]["band_min"] == 8.0
    # chunked global plan == plain window, tiny chunks to force many chunk borders
    from pyspark.sql import Window
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = S.rolling(ev, "ts", "value", tiebreak=["event_id"], chunk_rows=37, smooth_above=0, band_above=0)
    w = Window.orderBy("ts", "event_id")
    ref = ev.select("event_id", F.avg("value").over(w.rowsBetween(-9, 0)).alias("m"),
                    F.max("value").over(w.rowsBetween(-4, 0)).alias("mx"))
    bad = got.join(ref, "event_id").filter((F.abs(F.col("m") - F.col("rolling_mean")) > 1e-9)
                                           | (F.col("mx") != F.col("band_max"))).count()
    assert bad == 0 and got.count() == ev.count()


def test_monotonic(spark):
    df = spark.createDataFrame([(i, float(i * 2)) for i in range(10)], "o int, v double")
    assert S.is_monotonic(df, "v", ["o"]).collect()[0]["monotonic"] is True
    assert S.is_monotonic(df.withColumn("v", -F.col("v") * (F.col("o") % 2)), "v", ["o"]).collect()[0]["monotonic"] is False


def test_histogram_bins(spark):
    assert [A.auto_bins(n) for n in (9, 400, 10_000)] == [10, 20, 40]
    df = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    h = A.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in h] == [10] * 10  # max falls in the last bin
    assert sum(r["n"] for r in A.histogram(df, "v").collect()) == 100


def test_crosstab_zero_fill_and_top(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), (None, "x")], "c1 string, c2 string")
    ct = {(r["a"], r["b"]): r["n"] for r in A.crosstab(df, "c1", "c2").collect()}
    assert ct == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 2, ("b", "y"): 0}
    top = A.top_values(df, "c2", 1).collect()
    assert (top[0]["value"], top[0]["n"]) == ("x", 4)


def test_hierarchy_rollup_leaf_sum(spark):
    df = spark.createDataFrame([("r1", "n1", 1.0), ("r1", "n2", 2.0), ("r2", "n3", 4.0), (None, "n4", 8.0)],
                               "r string, n string, v double")
    h = A.hierarchy_rollup(df, ["r", "n"], "v").collect()
    root = [x["value"] for x in h if x["level"] == 0][0]
    assert root == sum(x["value"] for x in h if x["level"] == 2) == 7.0


def test_fuzzy_dictionary_x9(spark):
    d = spark.createDataFrame([("statut", "termine", "Terminé"), ("statut", "fin", "Terminé"),
                               ("statut", "abandonne", "Abandonné")], "column string, variant string, canonical string")
    df = spark.createDataFrame([("TERMINE",), ("abandone",), ("finn",), ("xx",), (None,), ("?",)], "statut string")
    got = [r[0] for r in Z.correct_exact_fuzzy(df, "statut", d).select("statut").collect()]
    assert sorted(got, key=str) == sorted(["Terminé", "Abandonné", "finn", "xx", None, None], key=str)


def test_reference_categories_known(spark):
    refs = Z.known_categories_df(spark)
    df = spark.createDataFrame([("terminé",), ("Formation Terminée",), ("cpf financé",), ("zzz",)], "statut string")
    strict = [r[0] for r in Z.reference_categories(df, "statut", refs, strict=True).collect()]
    assert set(strict) == {"Terminé", None}
    assert Z.is_strict_column("Statut_final") and not Z.is_strict_column("nom")


def test_html_tables_x13(spark):
    pages = [
        (1, "none", "<html><p>no table</p></html>"),
        (2, "one", "<table><tr><th> a </th><th>b</th><th>c</th></tr><tr><td>1</td><td>x</td><td></td></tr>"
                   "<tr><td>2</td><td>y</td><td>z</td></tr><tr><td></td><td> </td><td></td></tr></table>"),
        (3, "two", "<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>"
                   "<table><tr><th>p</th><th>q</th><th>r</th><th>s</th></tr>"
                   "<tr><td>1<td>&amp;<td>&eacute;<td>4</tr><tr><td colspan=2>w</td><td>3</td><td>5</td></tr>"
                   "<tr><td>7</td><td>8</td><td>9</td><td>10</td></tr></table>"),
        (4, "header only", "<table><tr><th>a</th></tr></table>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    best = {r["page_id"]: r for r in H.best_table(df).collect()}
    assert set(best) == {2, 3}
    assert (best[2]["rows"], best[2]["columns"], best[2]["missing_pct"]) == (2, 3, 16.67)
    assert list(best[2]["column_names"]) == ["a", "b", "c"]
    assert (best[3]["table_no"], best[3]["rows"], best[3]["columns"]) == (1, 3, 4)
    cells = {(r["row_no"], r["col_no"]): r["value"] for r in H.html_tables(df).filter("page_id = 3 AND table_no = 1").collect()}
    assert cells[(1, 1)] == "&" and cells[(1, 2)] == "é" and cells[(2, 1)] == "w"


def test_domain_detection_x2_x5(spark):
    cat = spark.createDataFrame(
        [("acc", c, i) for i, c in enumerate(["Num_Acc", "jour", "mois", "an", "lum", "atm"])]
        + [("form", c, i) for i, c in enumerate(["apprenant", "statut", "taux_completion"])]
        + [("sales", c, i) for i, c in enumerate(["Order ID", "Sales", "Segment"])]
        + [("hr", c, i) for i, c in enumerate(["employee_id", "departement", "salaire"])]
        + [("other", c, i) for i, c in enumerate(["x", "y"])],
        "table string, column string, ordinal int")
    got = {r["table"]: r["domain"] for r in Q.detect_domain(cat).collect()}
    assert got == {"acc": "accidents", "form": "formation", "sales": "ventes", "hr": "rh", "other": "generic"}


def test_intent_and_route(spark):
    df = spark.createDataFrame([("Quelle est l'évolution des ventes ?",), ("Répartition par segment",),
                                ("Quel lien entre prix et score ?",), ("outliers ?",), ("hello",)], "q string")
    got = [r[0] for r in df.select(Q.question_intent("q")).collect()]
    assert got == ["line", "pie", "scatter", "box", "bar"]
    routes = [r[0] for r in df.select(Q.question_route("q")).collect()]
    assert routes == ["numeric_distribution", "category_distribution", "correlation_matrix", "boxplot", "histogram"]


def test_question_plan_generic(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    prof = profile(df).collect()
    qs = Q.plan_questions(prof)
    assert 1 <= len(qs) <= 10
    keys = {(tuple(sorted(q["columns"])), q["chart"]) for q in qs}
    assert len(keys) == len(qs)
    assert all(c in df.columns for q in qs for c in q["columns"])


def test_exact_quantiles_bracket_path(spark):
    """Groups above 2*accuracy rows take the sketch-bracket path; compare to numpy."""
    import numpy as np

    rng = np.random.default_rng(7)
    big = rng.integers(0, 500, 30_000).astype(float)      # heavy ties, above 2A with accuracy=1000
    small = rng.normal(0, 1, 50)
    rows = [("big", float(v)) for v in big] + [("small", float(v)) for v in small]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in ST.exact_quantiles(df, "v", probs, by="g", accuracy=1000).collect()}
    for g, arr in (("big", big), ("small", small)):
        for p in probs:
            assert math.isclose(got[(g, p)], float(np.quantile(arr, p)), rel_tol=1e-12, abs_tol=1e-12), (g, p)
    one = {r["p"]: r["q"] for r in ST.exact_quantiles(df.filter("g = 'big'"), "v", [0.5], accuracy=1000).collect()}
    assert one[0.5] == float(np.quantile(big, 0.5))


def test_profile_approx_mode(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    exact = {r["column"]: r for r in profile(df).collect()}
    approx = {r["column"]: r for r in profile(df, exact_distinct=False).collect()}
    assert approx["l_extendedprice"]["nunique_exact"] is False
    assert abs(approx["l_extendedprice"]["nunique"] - exact["l_extendedprice"]["nunique"]) < 0.08 * exact["l_extendedprice"]["nunique"]
    for c in ("l_returnflag", "l_quantity", "l_shipdate"):
        assert approx[c]["nunique"] == exact[c]["nunique"] and approx[c]["data_type"] == exact[c]["data_type"]


def test_exact_quantiles_of_wide_brackets(spark):
    """Tiny accuracy makes wide brackets, of many slices."""
    import numpy as np

    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(0, 1, 20_000), np.full(5_000, 0.25)])
    df = spark.createDataFrame([("a" if i % 2 else "b", float(v)) for i, v in enumerate(vals)], "g string, v double")
    probs = [0.01, 0.25, 0.5, 0.9]
    got = {(r["g"], r["p"]): r["q"] for r in ST.exact_quantiles(
        df, "v", probs, by="g", accuracy=50).collect()}
    for g, arr in (("a", vals[1::2]), ("b", vals[0::2])):
        for p in probs:
            assert math.isclose(got[(g, p)], float(np.quantile(arr, p)), rel_tol=1e-12, abs_tol=1e-12), (g, p)
    one = {r["p"]: r["q"] for r in ST.exact_quantiles(df, "v", probs, accuracy=50).collect()}
    for p in probs:
        assert math.isclose(one[p], float(np.quantile(vals, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_rolling_hot_key_spans_chunks(spark):
    """A series key holding most rows is split over chunks; result = plain window."""
    from pyspark.sql import Window
    rows = [("hot" if i % 10 else f"k{i % 3}", i, float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, t long, v double")
    got = S.rolling(df, "t", "v", partition_cols=["key"], chunk_rows=97, smooth_above=0, band_above=0)
    w = Window.partitionBy("key").orderBy("t")
    ref = df.select("key", "t", (F.row_number().over(w) - 1).alias("rn"),
                    F.avg("v").over(w.rowsBetween(-9, 0)).alias("m"), F.min("v").over(w.rowsBetween(-4, 0)).alias("mn"))
    j = got.join(ref, ["key", "t"])
    assert j.count() == df.count() == got.count()
    assert j.filter((F.abs(F.col("m") - F.col("rolling_mean")) > 1e-9) | (F.col("mn") != F.col("band_min"))
                    | (F.col("rn") != F.col("row_idx"))).count() == 0


def test_identifier_like_with_order(spark):
    from tabulo.plans.dispatch import identifier_like

    rows = [(i, float(i if i % 100 else i - 1), float((i * 7) % 500)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "t long, seq double, other double")
    prof = profile(df).collect()
    # seq: 990/1000 distinct (0.99 < 0.995) but monotonic in t -> identifier-like with an order column
    assert identifier_like(df, "seq", prof) is False
    assert identifier_like(df, "seq", prof, order_cols=["t"]) is True
    assert identifier_like(df, "other", prof, order_cols=["t"]) is False


def test_awkward_column_names(spark):
    from tabulo.operators.clean import clean_table

    df = spark.createDataFrame([(1.5, "x"), (2.5, "y"), (3.5, "x")], "`a.b` double, `we``ird` string")
    p = profile(df).collect()
    assert {r["column"]: r["data_type"] for r in p} == {"a.b": "number", "we`ird": "category"}
    assert clean_table(df, p).columns == ["ab", "weird"]
    assert A.top_values(df, "we`ird").first()["value"] == "x"
    assert ST.boxplot_stats(df, "a.b").first()["median"] == 2.5


def test_dictionary_of_any_size(spark, monkeypatch):
    d = spark.createDataFrame([("c", f"v{i}", f"V{i}") for i in range(5)], "column string, variant string, canonical string")
    df = spark.createDataFrame([("v1",), ("v3",)], "c string")
    for bound in (0, 1_000_000):  # beyond the bound the mapping is joined by a shuffle
        monkeypatch.setattr(Z, "MAX_DICTIONARY_ROWS", bound)
        assert sorted(r[0] for r in Z.correct_exact_fuzzy(df, "c", d).collect()) == ["V1", "V3"]


def test_exact_quantiles_keep_the_null_group(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    groups = {(f"g{k}" if k else None): rng.integers(0, 50, 200 + 37 * k).astype(float) for k in range(6)}
    rows = [(g, float(v)) for g, arr in groups.items() for v in arr] + [("empty", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.1, 0.5, 0.75]
    for accuracy in (10_000, 20):
        got = {(r["g"], r["p"]): r["q"] for r in ST.exact_quantiles(df, "v", probs, by="g", accuracy=accuracy).collect()}
        assert len(got) == len(groups) * len(probs)
        for g, arr in groups.items():
            for p in probs:
                assert math.isclose(got[(g, p)], float(np.quantile(arr, p)), rel_tol=1e-12, abs_tol=1e-12), (g, p)


def test_nested_columns_are_passed_through(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cols = [r["column"] for r in profile(emb).collect()]
    assert cols == ["vec_id", "label"]                                   # array<float> not profiled
    only_nested = emb.select("embedding")
    assert profile(only_nested).collect() == []


def test_empty_inputs_everywhere(spark):
    from tabulo.operators.clean import clean_table
    from tabulo.plans.report import anomaly_log, cleaning_report

    e = spark.createDataFrame([], "k string, t long, v double, c string")
    assert S.rolling(e, "t", "v").count() == 0 and S.rolling(e, "t", "v", partition_cols=["k"]).count() == 0
    assert S.is_monotonic(e, "v", ["t"]).first()["n"] == 0
    assert ST.iqr_outliers(e, ["v"]).count() == 0 and ST.boxplot_stats(e, "v").count() == 0
    assert ST.linear_trend(e, "t", "v")[1].count() == 0
    assert A.value_shares(e, "c").count() == 0 and A.crosstab(e, "c", "k").count() == 0
    assert A.histogram(e, "v").count() == 0 and A.flow_edges(e, "k", "c").count() == 0
    assert A.hierarchy_rollup(e, ["k", "c"], "v").count() == 0
    prof = profile(e).collect()
    assert cleaning_report(e, clean_table(e, prof)).first()["rows_after"] == 0
    assert anomaly_log(e, prof).count() == 0


def test_nan_and_infinities_never_raise(spark):
    """NaN and +-inf in a double column go through every numeric operator
    under ANSI mode (NaN is NULL; infinities behave as pandas numbers)."""
    inf = float("inf")
    d = spark.createDataFrame([(float(v), i) for i, v in enumerate([1, 2, 3, inf, -inf, float("nan"), 5])],
                              "v double, t long")
    assert A.histogram(d, "v").count() > 0
    b = ST.boxplot_stats(d, "v").first()
    assert (b["n"], b["q1"], b["median"], b["n_outliers"]) == (6, 1.25, 2.5, 2)
    assert ST.iqr_outliers(d, ["v"]).first()["n_outliers"] == 2
    assert ST.correlation_matrix(d, ["v", "t"]).count() == 1
    assert ST.linear_trend(d, "t", "v")[0].count() == 1
    assert S.rolling(d, "t", "v").count() == 6
    assert {r["column"] for r in K.column_confidence(profile(d)).collect()} == {"v", "t"}

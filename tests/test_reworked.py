"""Accumulators, signatures, one-pass readers and rule tables against plain computations."""

import json
import math
import os
import random
import re
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulo.functions import dates as D
from tabulo.functions import names as N
from tabulo.functions.numbers import clean_number_locale
from tabulo.operators import clean as C
from tabulo.operators import fuzzy as Z
from tabulo.operators import moments as M
from tabulo.operators import series as S
from tabulo.operators import stats as ST
from tabulo.operators.profile import profile
from tabulo.plans import charts as CH
from tabulo.plans import dispatch as DP
from tabulo.plans import questions as Q
from tabulo.plans.report import anomaly_log
from tabulo.sources import files as FS
from tabulo.sources import html as H


def put(path, data):
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


# ---- A11

def pairwise(x, y):
    both = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[both], y[both]
    if np.isinf(x).any() or np.isinf(y).any():
        return math.nan, len(x)
    if not len(x) or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None, len(x)
    return float(np.corrcoef(x, y)[0, 1]), len(x)


@pytest.mark.parametrize("block", [256, 2])
def test_correlations_of_awkward_columns(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = np.random.default_rng(1)
    n = 500
    a = rng.normal(0, 1, n)
    cols = {"a": a, "big": 1e9 + a + rng.normal(0, 1, n), "gaps": np.where(rng.random(n) < 0.4, np.nan, 2 * a + rng.normal(0, 1, n)), "const": np.full(n, 0.1),
            "mostly": np.where(np.arange(n) % 2 == 0, 3.3, np.nan), "none": np.full(n, np.nan), "inf": np.where(np.arange(n) == 7, np.inf, a), "step": np.sort(a) * 1e-6}
    names = list(cols)
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*cols.values())], ", ".join(f"`{c}` double" for c in names)).repartition(5)
    got = {(r.c1, r.c2): (r.r, r.n) for r in ST.correlation_matrix(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (x, y), (r, k) in got.items():
        want, m = pairwise(cols[x], cols[y])
        assert k == m, (x, y)
        assert (r is None) == (want is None) and (r is None or (math.isnan(r) and math.isnan(want)) or math.isclose(r, want, abs_tol=1e-9)), (x, y, r, want)
    assert ST.correlation_matrix(df.limit(0), names).filter("n = 0 AND r IS NULL").count() == len(got)
    assert ST.correlation_matrix(df, ["a"]).count() == 0


def test_two_hundred_columns_in_one_pass(spark):
    df = spark.range(2000).select(*(F.rand(i).alias(f"c{i}") for i in range(200)))
    began = time.time()
    assert ST.correlation_matrix(df, df.columns).count() == 200 * 199 // 2
    assert time.time() - began < 60  # half of it on a free machine


# ---- A13 / A20

def test_iqr_of_many_columns(spark):
    rng = np.random.default_rng(3)
    cols = {f"c{k}": np.round(rng.standard_t(2, 3000), 2 if k % 2 else 6) for k in range(12)} | {"flat": np.full(3000, 5.0), "few": np.where(np.arange(3000) < 3, np.arange(3000.0), np.nan)}
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*cols.values())], ", ".join(f"{c} double" for c in cols))
    values = [F.when(~F.isnan(c), F.col(c)) for c in cols]
    for accuracy in (10_000, 100):  # all inside, and sketch brackets
        got = {r.column: r for r in ST.iqr_summary(df, list(cols), values, accuracy=accuracy, median=True).collect()}
        for c, x in cols.items():
            x = x[~np.isnan(x)]
            q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
            low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            r = got[c]
            assert np.allclose([r.q1, r.median, r.q3, r.lower, r.upper], [q1, q2, q3, low, high], rtol=1e-12, atol=1e-12), c
            assert r.n_outliers == ((x < low) | (x > high)).sum(), c


def test_anomalies_of_awkward_names(spark):
    rows = [(str(i) if i % 5 else "n/a", "AbC"[i % 3] + " ") for i in range(100)] + [("100000", None)]
    df = spark.createDataFrame(rows, "`Nombre d'enfants` string, `l'état` string")
    got = {(r.problem): r.n for r in anomaly_log(df, profile(df).collect()).collect()}
    assert got["number_lost"] == 20 and got["outliers"] == 1 and got["distinct_before"] == got["distinct_after"] == 3 if "number_lost" in got else got["distinct_before"] >= 3


# ---- C11 / C12

def edits(rng, word, k):
    w = list(word)
    for _ in range(k):
        at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        if kind == 0:
            w.insert(at, rng.choice("abcdeé"))
        elif w and at < len(w):
            w[at:at + 1] = [] if kind == 1 else [rng.choice("abcdeé")]
    return "".join(w)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_pieces_find_every_match(spark):
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 30))) for _ in range(150)})
    values = sorted({edits(rng, rng.choice(keys), rng.randint(0, 6)) for _ in range(300)} | {"", "a"})
    k = spark.createDataFrame([(x, i, x.upper()) for i, x in enumerate(keys)], "key string, ord int, canonical string")
    v = spark.createDataFrame([(x,) for x in values], "value_key string")
    got = {r.value_key: (r.key, r.ord) for r in Z.fuzzy_candidates(v, k).collect()}
    for x in values:
        scored = sorted((-100 * (1 - distance(x, y) / max(len(x), len(y))), i, y) for i, y in enumerate(keys) if max(len(x), len(y)))
        best = [s for s in scored if s[0] < -80]
        assert got.get(x) == ((best[0][2], best[0][1]) if best else None), x


def test_pairs_of_one_length_stay_few(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20))
    v = spark.createDataFrame([(word(),) for _ in range(2000)], "value_key string")
    k = spark.createDataFrame([(word(), 0, "c") for _ in range(1000)], "key string, ord int, canonical string")
    assert Z.piece_pairs(v, k).count() < 2000  # of 2,000,000


def test_containment_by_the_rarest_gram(spark):
    rng = random.Random(6)
    keys = ["a", "é", "ab", "", "zzz", *("".join(rng.choice("abcé ") for _ in range(rng.randint(2, 7))) for _ in range(60))]
    values = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 25))) for _ in range(200)} | {""})
    k = spark.createDataFrame([(x, i) for i, x in enumerate(keys)], "key string, ord int")
    v = spark.createDataFrame([(x,) for x in values], "value_key string")
    got = sorted((r.value_key, r.key, r.ord) for r in Z.contained_matches(v, k).collect())
    assert got == sorted((x, y, i) for x in values for i, y in enumerate(keys) if y and y in x)
    assert Z.contained_matches(v, k.limit(0)).count() == 0


def test_dictionaries_never_reach_the_driver(spark, monkeypatch):
    refs = spark.range(5000).select(F.lit("c").alias("column"), F.concat(F.lit("canon "), "id").alias("canonical"), F.concat(F.lit("variant number "), "id").alias("variant"), F.col("id").cast("int").alias("ord"))
    df = spark.createDataFrame([("a variant number 77 here",), ("variant numbr 4321",), ("xyz",)], "c string")
    collected = []
    inside = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(rows := inside(self)) or rows)
    out = Z.reference_categories(df, "c", refs, strict=False)
    assert all(len(rows) <= 3 for rows in collected)
    assert sorted(r.c for r in inside(out)) == ["canon 4321", "canon 7", "xyz"]  # 7 is contained before 77


# ---- W03

def test_monotonic_does_not_depend_on_the_partitions(spark):
    df = spark.range(3000).select((F.col("id") / 10).cast("int").alias("o"), (F.col("id") % 10 + F.col("id") / 10).alias("x"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("same"))
    for p in (1, 7):
        some = df.repartition(p, "v")
        assert S.is_monotonic(some, "v", ["o"]).first()[:] == (3000, True, True, False)
        assert S.is_monotonic(some, "same", ["o"]).first()[:] == (3000, True, True, True)
        assert S.is_monotonic(some.withColumn("v", -F.col("v")), "v", ["v"]).first()["monotonic"]
        assert not S.is_monotonic(some.withColumn("v", F.when(F.col("v") == 1500, 0.0).otherwise(F.col("v"))), "v", ["o"]).first()["monotonic"]


# ---- S11 - S13

PAGES = [(1, "<table><tr><th>a<th>b</tr><tr><td>1<td>x</tr><tr><td>2</tr></table><![bad]]><table><tr><td>lost</table>"), (None, "<table><tr><td>3</table>"), (None, None), (2, "no table"),
         (2, "<table><tr><th>h</table><table><tr><td> </table>")]


def test_pages_are_rows_whatever_they_hold(spark):
    df = spark.createDataFrame(PAGES, "page_id long, html string")
    rows = H.page_stats(df).collect()
    assert len(rows) == len(PAGES)
    assert [r.error is not None for r in sorted(rows, key=lambda r: (r.error is None))] == [True] + [False] * 4
    broken = next(r for r in rows if r.error)
    assert broken.page_id == 1 and broken.best.dtypes == ["int64", "object"] and broken.best.missing_pct == 25.0
    assert sum(r.page_id is None for r in rows) == 2 and [r.best.rows for r in rows if r.page_id is None and r.best] == [1]
    plan = H.best_table(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:MapInArrow|MapInPandas|ArrowEvalPython)", plan)) == 1 and "Exchange" not in plan


# ---- S01

def test_records_that_span_lines(spark, tmp_path):
    put(tmp_path / "a.csv", 'id,txt\n1,"a\nb"\n2,c\n3,"say ""hi"", you"\n')
    put(tmp_path / "b.csv", "id,txt\n4,d\n")
    got = {(r.id, r.txt) for r in FS.read_any(spark, str(tmp_path), fmt="csv").collect()}
    assert got == {("1", "a\nb"), ("2", "c"), ("3", 'say "hi", you'), ("4", "d")}
    assert {os.path.basename(r.file): r.spans for r in FS.sniff_files(spark, str(tmp_path)).collect()} == {"a.csv": True, "b.csv": False}


def test_json_of_every_form(spark, tmp_path):
    forms = {"lines": '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n', "one": '{"a": 3, "b": "y"}', "array": '\n[{"a": 4, "b": "z"},\n {"a": 5}]', "pretty": json.dumps([{"a": 6, "b": "w"}], indent=2),
             "columns": json.dumps({"a": {"0": 7, "1": 8}, "b": {"1": "v", "0": None}}), "tall": json.dumps({"a": {"0": 9}, "b": {"0": "u"}}, indent=1), "lists": json.dumps({"a": [10, 11], "b": ["t", "s"]})}
    for name, text in forms.items():
        put(tmp_path / f"{name}.json", text)
    found = {os.path.basename(r.file)[:-5]: r.form for r in FS.json_forms(spark, str(tmp_path)).collect()}
    assert found == {"lines": "lines", "one": "document", "array": "document", "pretty": "document", "columns": "columns", "tall": "columns", "lists": "columns"}
    got = sorted(((str(r.a), r.b) for r in FS.read_any(spark, str(tmp_path), fmt="json").collect()), key=lambda x: int(x[0]))
    assert got == [("1", "x"), ("2", None), ("3", "y"), ("4", "z"), ("5", None), ("6", "w"), ("7", None), ("8", "v"), ("9", "u"), ("10", "t"), ("11", "s")]


# ---- names, numbers, dates

def test_names_are_unique_in_their_group(spark):
    rows = [("t", i, x) for i, x in enumerate(["montant", "montant", "montant_2", "Montant", "x"])] + [(None, 0, "montant"), (None, 1, "montant")]
    df = spark.createDataFrame(rows, "g string, o int, n string")
    got = {(r.g, r.o): r.final_name for r in N.dedupe_names(df, "n", "o", ["g"]).collect()}
    assert got == {("t", 0): "montant", ("t", 1): "montant_3", ("t", 2): "montant_2", ("t", 3): "Montant_4", ("t", 4): "x", (None, 0): "montant", (None, 1): "montant_2"}


def test_names_of_large_groups_are_unique(spark):
    """Names with suffixes of their own, cases, nulls and one group of thousands of rows, against the rule word for word."""
    rng = random.Random(5)
    pool = ["x", "X", "x_2", "x_5", "x_02", "x_2_2", "X_2_3", "y", "y_1", "y_4", "y_99999999999", "_2", "", None]
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(pool)) for i in range(400)] + [("big", i, rng.choice(["Montant", "montant_2", "montant_7"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, o int, n string")
    want = {}
    for g in ("a", "b", None, "big"):
        mine = [r for r in rows if r[0] == g]
        wanted, given, last = {n.lower() for _, _, n in mine if n is not None}, set(), {}
        for _, o, n in mine:
            final = n
            if n is not None and n.lower() in given:
                k = last.get(n.lower(), 1) + 1
                while f"{n}_{k}".lower() in given or f"{n}_{k}".lower() in wanted:
                    k += 1
                last[n.lower()], final = k, f"{n}_{k}"
            given |= {final.lower()} if final is not None else set()
            want[g, o] = final
    # a loop over every suffix and name of a group would take minutes here
    start = time.monotonic()
    got = {(r.g, r.o): r.final_name for r in N.dedupe_names(df, "n", "o", ["g"]).collect()}
    assert got == want
    assert time.monotonic() - start < 60


def test_the_merged_date_has_a_name_of_its_own(spark):
    df = spark.createDataFrame([("1", "2", "2024", "2020-01-01"), ("3", "4", "2024", "2020-01-02")], "jour string, mois string, an string, dt string")
    prof = profile(df).collect()
    for rename in (True, False):
        out = C.clean_table(df, prof, rename=rename)
        assert len({c.lower() for c in out.columns}) == len(out.columns) == 5 and "date" in out.columns
    other = C.clean_table(df.withColumnRenamed("dt", "date"), profile(df.withColumnRenamed("dt", "date")).collect(), rename=False)
    assert other.columns[-1] == "date_2"


def dated(rng):
    d, m, y = rng.randint(0, 33), rng.randint(0, 13), rng.choice([rng.randint(1990, 2030), rng.randint(0, 99), 12345])
    month = rng.choice(["Jan", "January", "Feb", "March", "xyz"])
    text = rng.choice(["{y}-{m}-{d}", "{y}-{m:02}-{d:02}", "{d}/{m}/{y}", "{d}-{m}-{y}", "{m}/{d}/{y}", "{d}.{m}.{y}", "{y}{m:02}{d:02}", "{d} {month} {y}", "{month} {d}, {y}", "{y}/{m}/{d}", "-{y}-{m}-{d}", "+{y}-{m}-{d}", "{d}/{m}",
                       "{y}-{m:02}-{d:02}T10:11:12", " {d}/{m}/{y} ", "{y}", "{d}:{m}"])
    return text.format(d=d, m=m, y=y, month=month)


def test_layouts_that_cannot_fit_change_nothing(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(dated(rng),) for _ in range(3000)] + [("",), (None,), ("né le 3",)], "s string")
    s = F.regexp_replace("s", r"^\s+|\s+$", "")
    for found, patterns, extra in ((D.clean_date_multi("s"), D.EXTENDED_PATTERNS, [F.when(s.rlike(r"^[+-]?\d{4}"), s.try_cast("timestamp"))]), (D.clean_date_basic("s"), D.BASIC_PATTERNS, [])):
        plain = F.coalesce(*(F.try_to_timestamp(s, F.lit(p)) for p in patterns), *extra).cast("date")
        bad = df.select("s", found.cast("string").alias("a"), plain.cast("string").alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).collect()
        assert not bad, bad[:5]
    assert df.filter(D.clean_date_multi("s").isNotNull()).count() > 500


def locale_number(text):
    """The documented rules, in plain Python."""
    s0 = re.sub("[€$£%\\s\u00a0\u202f]", "", text)
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+", s0):
        return float(s0)
    s1 = re.sub(r"[^0-9.,\-]", "", s0)
    commas, dots = s1.count(","), s1.count(".")
    if commas and dots:
        s1 = s1.replace(".", "").replace(",", ".") if s1.rfind(",") > s1.rfind(".") else s1.replace(",", "")
    elif commas > 1:
        s1 = s1.replace(",", "")
    elif commas:
        s1 = s1.replace(",", ".")
    elif dots > 1:
        s1 = s1.replace(".", "")
    return float(s1) if re.fullmatch(r"-?([0-9]+\.?[0-9]*|\.[0-9]+)", s1) else None


def test_locale_numbers_follow_the_rules(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789.,-€ e+x\u00a0\u202f\t") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["1.234,56", "1,234,567", "1e3", "1.2.3", "", "12", "-.5", "5.", "12f"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string")
    for r in df.select("s", clean_number_locale("s").alias("v")).collect():
        assert r.v == (None if r.s is None else locale_number(r.s)), r


# ---- Q01, Q03, Q08

def plan(spark, columns, **kw):
    """columns: (name, role, distinct values)"""
    prof = [dict(ordinal=i, column=c, role=role, nunique=n, nulls=0) for i, (c, role, n) in enumerate(columns)]
    return [(q["columns"], q["chart"]) for q in Q.plan_questions(prof, **kw)]


def test_accident_rules(spark):
    got = plan(spark, [("Num_Acc", "forbidden", 99), ("dep", "code", 40), ("code_lum", "code", 5), ("code_col", "code", 7), ("agglo", "code", 2), ("inter", "code", 9), ("hrmn", "measure", 900), ("lat", "measure", 999), ("jour", "forbidden", 31)])
    # the first code has too many values for a pie, the rest goes by fragments of the codes' names
    assert got == [(["code_lum", "code_col"], "bar"), (["agglo"], "pie"), (["inter"], "histogram"), (["hrmn"], "line"), (["hrmn", "lat"], "scatter"), (["jour"], "bar")]


def test_fallbacks_and_themes(spark):
    assert plan(spark, [("salary_rh", "constant", 1), ("b", "forbidden", 3)]) == [(["b"], "bar")]
    assert plan(spark, [("salary_rh", "constant", 1)]) == [] and Q.plan_questions([]) == []
    assert plan(spark, [("u", "code", 3), ("v", "code", 4)]) == [(["u"], "pie"), (["u"], "histogram"), (["u", "u"], "bar"), (["v", "u"], "bar")]
    prof = [dict(ordinal=0, column="a", role="measure", nunique=50, nulls=0)]
    texts = {t: Q.plan_questions(prof, theme=t)[0]["purpose"] for t in (None, "nosuch", " Sante ", "sante", "ventes")}
    assert texts[None] == texts["nosuch"] == Q.purpose("generic", 2) and texts[" Sante "] == texts["sante"] == Q.purpose("sante", 2) != texts["ventes"]
    assert len({Q.purpose(t, k) for t in Q.THEMES for k in range(1, 6)}) == 35 and Q.purpose("ventes", 6) == Q.purpose("rh", 9)


def in_turn(texts, kinds, limit=20):
    used, out = set(), []
    first = lambda xs: next((c for c in xs if c not in used), xs[0])
    for text in texts[:limit]:
        low = text.lower()
        route = next((n for n, words in Q.ROUTE_WORDS if any(w in low for w in words)), "histogram")
        num, cat, date = kinds["num"], kinds["cat"], kinds["date"]
        cols = []
        if route == "category_distribution" and cat:
            cols = [first(cat)]
        elif route == "mean_by_category" and cat and num:
            cols = [first(cat), first(num)]
        elif route in ("boxplot", "histogram") and num or route == "numeric_distribution" and num and date:
            cols = [first(num)]
        used.update(cols)
        out.append((route, cols))
    return out


@pytest.mark.parametrize("date", [["d"], []])
def test_routing_uses_columns_up(spark, date):
    rng = random.Random(10)
    words = [w for _, ws in Q.ROUTE_WORDS for w in ws] + ["bonjour"]
    lists = {g: [rng.choice(words) for _ in range(rng.randint(1, 30))] for g in (None, 1, 2, 3)}
    df = spark.createDataFrame([(g, i, t) for g, ts in lists.items() for i, t in enumerate(ts)], "g int, i int, q string").repartition(4)
    kinds = {"num": ["n1", "n2", "n3"], "cat": ["c1", "c2"], "date": date}
    got = {}
    for r in sorted(Q.route_questions(df, "q", ["g"], ["i"], kinds).collect(), key=lambda r: r.i):
        got.setdefault(r.g, []).append((r.route, list(r.columns)))
    assert got == {g: in_turn(ts, kinds) for g, ts in lists.items()}
    assert Q.route_questions(df, "q", ["g"], ["i"], {}).filter(F.size("columns") > 0).count() == 0


# ---- Q04 - Q06

def test_many_charts_share_their_scans(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 70).cast("double").alias("y"), F.concat(F.lit("s"), F.col("id") % 3).alias("segment"), F.concat(F.lit("r"), F.col("id") % 7).alias("region"),
                                 F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("d"))
    prof = profile(df).collect()
    reads, passes = [], []
    write = CH.Data.write
    monkeypatch.setattr(CH.Data, "write", lambda self: reads.append(1) or write(self))
    explode = F.explode
    monkeypatch.setattr(F, "explode", lambda c: passes.append(os.path.basename(sys._getframe(1).f_code.co_filename)) or explode(c))
    charts = DP.dashboard(df, prof)
    out = CH.draw(df, list(enumerate(charts, 1)))
    assert len(charts) >= 10 and len(reads) == 1 and passes.count("charts.py") == 1  # all cells of all charts
    alone = CH.draw(df, [(1, charts[0])]).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in out.filter("qid = 1").collect())
    assert out.select("qid").distinct().count() == len(charts)
    assert DP.answer_questions(df, [], prof).count() == 0

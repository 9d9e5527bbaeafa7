"""No caps, prefixes or lost rows: sources, names, samples, series and question answers."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulo.functions.dates import clean_date_multi
from tabulo.operators import agg as A
from tabulo.operators import clean as C
from tabulo.operators import series as S
from tabulo.operators import stats as ST
from tabulo.operators.profile import profile
from tabulo.plans import dispatch as D
from tabulo.session import ensure_checkpoint_dir
from tabulo.sources.files import read_any
from tabulo.sources.html import parse_page


def put(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_sample_is_exact_on_equal_rows_and_small_n(spark):
    same = spark.range(5000).select(F.lit(1).alias("a"))
    assert A.bounded_sample(same, 1000).count() == 1000
    rows = spark.range(20_000).select(F.col("id").alias("a"))
    for seed in range(3):
        got = [r.a for r in A.bounded_sample(rows, 10, seed=seed).collect()]
        assert len(set(got)) == 10 and sorted(got) == sorted(r.a for r in A.bounded_sample(rows.repartition(7), 10, seed=seed).collect())
    assert A.bounded_sample(rows, 30_000).count() == 20_000 and A.bounded_sample(rows.limit(0), 5).count() == 0


def test_bubble_keeps_every_row(spark):
    df = spark.range(130_000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert A.bubble_projection(df, "x", "y").count() == 130_000


def test_landing_folder_of_unlike_files(spark):
    d = tempfile.mkdtemp(prefix="land in ")
    put(d, "a b.csv", "id,name\n1,x\n".encode())
    put(d, "b.csv", "name,id\ny,2\n".encode())
    put(d, "c.csv", "id;name\n3;été\n".encode("latin-1"))
    got = {(r["id"], r["name"]) for r in read_any(spark, d, fmt="csv").collect()}
    assert got == {("1", "x"), ("2", "y"), ("3", "été")}


def test_encoding_is_judged_on_every_split(spark):
    d = tempfile.mkdtemp()
    put(d, "big.csv", b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(40_000)) + "40000,Terminé\n".encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert read_any(spark, f"{d}/big.csv").filter("id = 40000").first()["name"] == "Terminé"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_kind_is_found_for_each_file(spark):
    d = tempfile.mkdtemp()
    put(d, "a.json", b'\n\n[{"a": 1}, {"a": 2}]')
    put(d, "b.json", b'{"a": 3}\n{"a": 4}\n')
    assert sorted(r.a for r in read_any(spark, d, fmt="json").collect()) == [1, 2, 3, 4]


def test_renamed_columns_are_unique():
    row = lambda i, c, p, kind="text": dict(ordinal=i, column=c, proposed_name=p, data_type=kind)
    got = C.rename_map([row(0, "prix", "montant"), row(1, "total", "montant"), row(2, "montant_2", "montant_2")])
    assert got == {"prix": "montant", "total": "montant_3", "montant_2": "montant_2"}
    assert C.rename_map([row(0, "identifiant", "identifiant", "id"), row(1, "code", "identifiant")]) == {"code": "identifiant_2"}


def test_names_and_labels_are_never_sql(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a`b", "x'y"), (2.0, 3.0, "c.d", 'q"')], ["Nombre d'enfants", "it`s", "k", "l"])
    assert ST.correlation_matrix(df, ["Nombre d'enfants", "it`s"]).first().n == 2
    got = {(r.a, r.b): r.n for r in A.crosstab(df, "k", "l").collect()}
    assert got == {("a`b", "x'y"): 1, ("a`b", 'q"'): 0, ("c.d", "x'y"): 0, ("c.d", 'q"'): 1}


def test_crosstab_labels_stay_in_spark(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 40).alias("k"), (F.col("id") * F.col("id") % 700).alias("l"))
    rows = [(str(r.k), str(r.l)) for r in df.collect()]
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: pytest.fail("labels went to the driver"))
        out = A.crosstab(df, "k", "l")
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = {(r.a, r.b): r.n for r in out.collect()}
    assert got == {(a, b): 0 for a in {x[0] for x in rows} for b in {x[1] for x in rows}} | dict(Counter(rows)) and out.count() == len(got)
    some = A.crosstab(df, "k", "l", a_labels=["1", "2"], b_labels=["1", "none"])
    assert {(r.a, r.b): r.n for r in some.collect()} == {(a, b): rows.count((a, b)) for a in "12" for b in ("1", "none")}


def test_null_series_key_keeps_its_rows(spark):
    df = spark.range(30).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    assert S.rolling(df, "t", "v", ["g"]).count() == 30


def test_a_bare_time_is_no_date(spark):
    got = spark.createDataFrame([("12:30",), ("2024-02-03T10:00:00",)], ["s"]).select(clean_date_multi("s").alias("d")).collect()
    assert got[0].d is None and str(got[1].d) == "2024-02-03"


def answers(df, cols, chart):
    rows = profile(df).collect()
    return D.aggregate_for_question(df, dict(qid=1, columns=cols, chart=chart), rows), rows


def test_two_columns_are_answered_whatever_the_chart(spark):
    df = spark.range(400).select(F.concat(F.lit("kind "), F.chr(F.lit(97) + F.col("id") % 4)).alias("cat"), (F.col("id") * 1.5 + 0.25).alias("x"), (F.sqrt("id") + 0.5).alias("y"))
    for chart in ("bar", "pie", "line"):
        assert answers(df, ["cat", "x"], chart)[0].count() == 4
    for chart in ("scatter", "bar"):
        assert answers(df, ["x", "y"], chart)[0].count() > 0


def test_line_of_tied_dates_does_not_depend_on_the_order(spark):
    df = spark.range(2000).select(F.lit("2024-01-01").cast("date").alias("d"), F.hash("id").cast("double").alias("v"))
    sums = {answers(df.orderBy(F.hash("v", F.lit(i))), ["d", "v"], "line")[0].agg(F.sum(F.xxhash64("y").cast("decimal(38,0)"))).first()[0] for i in range(2)}
    assert len(sums) == 1


def test_line_needs_three_values(spark):
    df = spark.createDataFrame([("2024-01-01", 1.5), ("2024-01-02", 2.5)], ["d", "v"]).withColumn("d", F.col("d").cast("date"))
    assert answers(df, ["d", "v"], "line")[0].count() == 0


def cells(html):
    (table,), error = parse_page(html)
    assert error is None
    return table["rows"]


def test_spans_of_cells():
    assert cells("<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</tr></table>") == [["a", "b"], ["a", "c"]]
    assert cells("<table><tr><td>a<td rowspan=3 colspan=2>b</tr><tr><td>c</tr><tr><td>d</tr></table>") == [["a", "b", "b"], ["c", "b", "b"], ["d", "b", "b"]]
    assert len(cells("<table><tr><td colspan=1500>x</table>")[0]) == 1500


def test_cluster_needs_a_shared_checkpoint_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context})())

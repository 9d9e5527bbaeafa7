"""File sources (S01-S07, S09, S10) on small files written by the test."""

import os

from pyspark.sql import functions as F

from tabulo.operators.profile import profile
from tabulo.sources import files as FS
from tabulo.plans import questions as Q


def _write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_separator_rules_x10(spark):
    lines = ["a;b,c;d", "a,b;c", "a, b, c", "nom prenom", "single", "a\tb\tc", "a|b|c"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0] for r in df.select(FS.separator_expr(F.col("line"))).collect()]
    assert got == [";", ",", ",", " ", ",", "\t", "|"]


def test_read_any_sniffs_and_groups(spark, tmp_path):
    d = tmp_path / "zone"
    d.mkdir()
    _write(d / "a.csv", "nom;montant\nAlice;12,5\nBob;3\n")
    _write(d / "b.csv", "nom;montant\nÉlodie;1 234,56\n", encoding="latin-1")
    sniffed = {os.path.basename(r["file"]): (r["sep"], r["encoding"]) for r in FS.sniff_files(spark, str(d)).collect()}
    assert sniffed == {"a.csv": (";", "UTF-8"), "b.csv": (";", "ISO-8859-1")}
    df = FS.read_any(spark, str(d), fmt=".csv")
    assert sorted(df.columns) == ["montant", "nom"]
    assert sorted(r["nom"] for r in df.collect()) == ["Alice", "Bob", "Élodie"]
    assert all(t == "string" for _, t in df.dtypes)  # all-string read, typed by the profile


def test_read_tsv_json_parquet(spark, tmp_path):
    _write(tmp_path / "t.tsv", "a\tb\n1\tx\n2\ty\n")
    assert FS.read_any(spark, str(tmp_path / "t.tsv")).count() == 2
    _write(tmp_path / "arr.json", '[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    _write(tmp_path / "lines.json", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert FS.read_any(spark, str(tmp_path / "arr.json")).count() == 2
    assert FS.read_any(spark, str(tmp_path / "lines.json")).count() == 3
    assert FS.read_any(spark, "/root/testdata/sf0.001/region.parquet").count() == 5
    assert FS.preview(FS.read_any(spark, "/root/testdata/sf0.001/orders.parquet")).count() == 5


def test_list_and_validate(spark, tmp_path):
    _write(tmp_path / "ok.csv", "x\n" + "1\n" * 600)
    _write(tmp_path / "tiny.csv", "x\n1\n")
    _write(tmp_path / "notes.md", "# hello\n" * 200)
    v = {os.path.basename(r["path"]): (r["valid"], r["reason"]) for r in FS.validate_files(spark, str(tmp_path)).collect()}
    assert v["ok.csv"] == (True, "OK")
    assert v["tiny.csv"] == (False, "empty file")
    assert v["notes.md"] == (False, "invalid format")
    only_csv = FS.list_files(spark, str(tmp_path), glob="*.csv").count()
    assert only_csv == 2


def test_write_and_reread(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    FS.write_table(df, str(tmp_path / "out"))
    back = FS.read_any(spark, str(tmp_path / "out"), fmt=".csv")
    assert back.count() == df.count() and back.columns == df.columns
    prof = profile(df)
    FS.write_report(prof, str(tmp_path / "prof"), fmt="json")
    assert spark.read.json(str(tmp_path / "prof")).count() == len(df.columns)


def test_dimensions_and_low_cardinality(spark):
    df = spark.createDataFrame(
        [(i, f"seg{i % 3}", f"reg{i % 4}", f"x{i % 5}", float(i % 7), float(i)) for i in range(200)],
        "id long, segment string, region string, other string, small double, big double")
    prof = profile(df).collect()
    dims = Q.dimensions(prof)
    assert dims == {"segment": "segment", "region": "region", "other": "other"}
    assert Q.low_cardinality_numeric(prof, k=3) == ["id", "small", "big"]
    assert Q.low_cardinality_numeric(prof, used=["id"], k=1) == ["small"]
    assert Q.main_metric(df, ["small", "big"]) == "big"


def test_dimensions_last_pattern_wins(spark):
    df = spark.createDataFrame([(f"s{i % 3}", f"t{i % 2}", f"c{i % 4}") for i in range(40)],
                               "segment string, type string, city string")
    dims = Q.dimensions(profile(df).collect())
    assert dims == {"segment": "type", "region": "city", "other": "segment"}

"""Scalar cleaners against the hand-worked values of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from tabulo.functions import dates as D
from tabulo.functions import names as N
from tabulo.functions import numbers as NUM
from tabulo.functions import text as T
from tabulo.operators import clean as C


def _one(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


X7 = [
    (" 12,5 ", 12.5, 12.5), ("1 234,56 €", None, 1234.56), ("1,234.56", None, 1234.56),
    ("1.234,56", None, 1234.56), ("1.234.567,89", None, 1234567.89), ("1,234,567", None, 1234567.0),
    ("12%", None, 12.0), ("-3,2", -3.2, -3.2), ("12-3", None, None), ("1e3", 1000.0, 1000.0),
    ("12f", None, 12.0), ("1_000", None, 1000.0), ("inf", None, None), ("nan", None, None),
    ("abc", None, None), ("", None, None), (None, None, None),
]


def test_number_cleaners(spark):
    raw = [x for x, _, _ in X7]
    assert _one(spark, raw, NUM.clean_number_basic) == [b for _, b, _ in X7]
    assert _one(spark, raw, NUM.clean_number_locale) == [c for _, _, c in X7]


def test_number_cleaner_idempotent(spark):
    raw = [x for x, _, _ in X7]
    df = spark.createDataFrame([(v,) for v in raw], "x string")
    once = df.select(NUM.clean_number_locale("x").cast("string").alias("x"))
    twice = once.select(NUM.clean_number_locale("x").alias("y"), F.col("x").cast("double").alias("x"))
    assert all(r["x"] == r["y"] for r in twice.collect())


X8 = [
    ("31/12/2021", "2021-12-31", "2021-12-31"), ("31-12-2021", "2021-12-31", "2021-12-31"),
    ("31.12.2021", "2021-12-31", "2021-12-31"), ("2021-12-31", "2021-12-31", "2021-12-31"),
    ("2021/12/31", "2021-12-31", "2021-12-31"), ("01/02/2021", "2021-02-01", "2021-02-01"),
    ("12/31/2021", None, "2021-12-31"), ("20211231", None, "2021-12-31"), ("31 Dec 2021", None, "2021-12-31"),
    ("31 December 2021", None, "2021-12-31"), ("Dec 31, 2021", None, "2021-12-31"),
    ("2021-02-30", None, None), ("31/02/2021", None, None), ("hello", None, None), ("", None, None),
    (None, None, None),
]


def test_date_cleaners(spark):
    raw = [x for x, _, _ in X8]
    basic = _one(spark, raw, lambda c: D.clean_date_basic(c).cast("string"))
    multi = _one(spark, raw, lambda c: D.clean_date_multi(c).cast("string"))
    assert basic == [b for _, b, _ in X8]
    assert multi == [m for _, _, m in X8]


def test_merge_day_month_year(spark):
    df = spark.createDataFrame([(3, 2, 2021), (30, 2, 2021), (None, 2, 2021)], "d int, m int, y int")
    got = [r[0] for r in df.select(D.merge_day_month_year("d", "m", "y").cast("string")).collect()]
    assert got == ["2021-02-03", None, None]


def test_categories(spark):
    raw = ["  Terminé ", "RÉGION", "œuvre", "", "?", "--", "Inconnu", "NULL"]
    assert _one(spark, raw, T.normalize_category) == ["termine", "region", "œuvre", None, "?", "--", "inconnu", "null"]
    assert _one(spark, raw, T.empty_to_null) == ["Terminé", "RÉGION", "œuvre", None, None, None, None, None]


def test_snake_case_and_suggestions(spark):
    names = ["OrderID", "CodePostal", "Montant (€)", "Année", "prixUnitaire", "qty", "id",
             "hrmn", "lum", "jour", "Num_Acc", "long"]
    got = _one(spark, names, N.snake_case)
    assert got == ["order_id", "code_postal", "montant", "date", "prix_unitaire", "nombre", "identifiant",
                   "heure_minute", "luminosite", "date_jour", "num_acc", "longitude"]
    assert _one(spark, ["qty", "cp", "xyzxyz"], N.suggest_name) == ["quantité", "Cp", "xyzxyz"]


def test_rename_collisions(spark):
    cat = spark.createDataFrame([("t", "prix", 1), ("t", "total", 2), ("t", "autre", 3)],
                                "table string, name string, ordinal int")
    cat = cat.withColumn("proposed", N.snake_case(F.col("name")))
    got = {r["name"]: r["final_name"] for r in N.dedupe_names(cat, "proposed", "ordinal", ["table"]).collect()}
    assert got == {"prix": "montant", "total": "montant_2", "autre": "autre"}


def test_forbidden_names(spark):
    names = ["id", "client_id", "id_client", "jour", "latitude", "Num_Acc", "valeur", "pk-x", "idee"]
    assert _one(spark, names, N.is_forbidden) == [True, True, True, True, True, True, False, True, False]


def test_realign_x6(spark):
    rows = [(None, "Abandon"), (None, "1a"), (None, "12"), ("ok", "Abandon"), (None, None)]
    df = spark.createDataFrame(rows, "etat string, note string")
    load = [tuple(r) for r in C.realign(df, "etat", "note", "[A-Za-z]").collect()]
    clean = [tuple(r) for r in C.realign(df, "etat", "note", "^[A-Za-z]").collect()]
    assert load == [("Abandon", None), ("1a", None), (None, "12"), ("ok", "Abandon"), (None, None)]
    assert clean == [("Abandon", None), (None, "1a"), (None, "12"), ("ok", "Abandon"), (None, None)]


def test_accent_table_is_generated():
    src, dst = T.accent_table()
    assert len(src) == len(dst) > 1000
    assert "é" in src and "œ" not in src


@pytest.mark.parametrize("streaming_ok", [True])
def test_cleaners_are_row_local(spark, streaming_ok, tmp_path):
    """C16 runs unchanged on a streaming DataFrame."""
    from tabulo.operators.profile import profile
    from tabulo.streaming.clean_stream import run_clean_stream

    src = tmp_path / "in"
    df = spark.createDataFrame([("1,5", "Terminé", "2021-01-02"), ("2", "En cours", "n/a")] * 5,
                               "montant string, statut string, date_debut string")
    df.write.parquet(str(src))
    prof = profile(df).collect()
    q = run_clean_stream(spark, str(src), df.schema, prof, str(tmp_path / "out"), name="t1")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10
    assert set(out.columns) >= {"montant", "statut"}
    assert {r["statut"] for r in out.collect()} == {"termine", "en cours"}


def test_clean_table_rules(spark):
    from tabulo.operators.profile import profile

    rows = [(str(i), f"{i},5" if i % 4 else "n/a", "Terminé" if i % 2 else " En cours", 1 + i % 28, 1 + i % 12, 2020,
             str(10 * i), str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "client_id string, prix string, statut string, jour int, mois int, an int, "
                                     "total string, valeur string")
    prof = profile(df).collect()
    types = {r["column"]: r["data_type"] for r in prof}
    assert types["client_id"] == "id" and types["statut"] == "category"
    out = C.clean_table(df, prof)
    cols = out.columns
    assert "client_id" in cols and "date" in cols                    # F5: id kept; C06 merged date added
    assert {"montant", "montant_2"} <= set(cols)                     # prix/total collide on "montant"
    first = out.orderBy(F.col("client_id").cast("int")).first()
    assert str(first["date"])[:10] == "2020-01-01"
    assert {r["statut"] for r in out.select("statut").distinct().collect()} == {"termine", "en cours"}
    trimmed = C.clean_table(df, prof, mode="trim", rename=False)     # C08: trim only
    assert {r["statut"] for r in trimmed.select("statut").distinct().collect()} == {"Terminé", "En cours"}


def test_proposals_policies_and_overrides(spark):
    props = spark.createDataFrame([("a", "alpha", "number", 0.9), ("b", "beta", "date", 0.6)],
                                  "column string, proposed_name string, data_type string, confidence double")
    auto = {r["column"]: (r["final_name"], r["final_type"]) for r in C.accept_proposals(props).collect()}
    assert auto == {"a": ("alpha", "number"), "b": ("b", "text")}
    fix_all = {r["column"]: r["final_name"] for r in C.accept_proposals(props, "fix_all").collect()}
    assert fix_all == {"a": "alpha", "b": "beta"}
    ov = spark.createDataFrame([("b", "BETA", None)], "column string, name string, type string")
    got = {r["column"]: (r["proposed_name"], r["data_type"]) for r in C.apply_overrides(props, ov).collect()}
    assert got == {"a": ("alpha", "number"), "b": ("BETA", "date")}


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(None, None), ("x", None), (None, 1.0)], "a string, b double")
    assert C.drop_empty_rows(df).count() == 2
    assert C.drop_empty_rows(df, ["b"]).count() == 1


def test_apply_dictionaries(spark):
    from tabulo.operators.profile import profile

    rows = [("Terminé", "cpf", "Débutant"), ("termine ", "région", "Expert"), ("TERMINEE", "opco", "expert"),
            ("inconnu", "CPF", "Avancé"), ("Abandonné", "xyz", "avance")] * 4
    df = spark.createDataFrame(rows, "statut string, financeur string, niveau_label string")
    prof = profile(df).collect()
    d = spark.createDataFrame([("financeur", "cpf", "CPF"), ("financeur", "region", "Région")],
                              "column string, variant string, canonical string")
    out = C.apply_dictionaries(df, prof, dictionary=d)
    got = {(r["statut"], r["financeur"]) for r in out.select("statut", "financeur").collect()}
    statuts = {s for s, _ in got}
    assert statuts == {"Terminé", "Abandonné", None}     # strict column mapped onto the known list
    assert {f for _, f in got} >= {"CPF", "Région", "xyz"}  # dictionary column: exact/fuzzy, else kept

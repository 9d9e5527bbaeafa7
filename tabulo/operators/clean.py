"""Whole-table cleaning.

``clean_table`` turns the collected profile (one row per column) into ONE
``select`` of native cleaner expressions: a single narrow, codegen'd stage,
no shuffle, valid on a streaming DataFrame too.  No row-count-dependent
behaviour (deviation D4): ``mode='trim'`` exists but is never chosen by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import qcol
from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T

AUTO_ACCEPT = 0.7  # fixed value (C17)


def _q(c: str):
    return qcol(c)


# ---------------------------------------------------------------- C15
def realign(df: DataFrame, target: str = "etat", source: str = "note", pattern: str = "^[A-Za-z]") -> DataFrame:
    """Where ``target`` is NULL and ``source`` matches ``pattern``, move
    the value to ``target`` and NULL ``source``.  Load-time rule: pattern
    ``[A-Za-z]`` (a letter anywhere); clean-time rule: ``^[A-Za-z]``."""
    if target not in df.columns or source not in df.columns:
        return df
    src = _q(source).cast("string")
    move = _q(target).isNull() & src.isNotNull() & src.rlike(pattern)
    cols = []
    for c in df.columns:
        if c == target:
            cols.append(F.when(move, src).otherwise(_q(target).cast("string")).alias(c))
        elif c == source:
            cols.append(F.when(move, F.lit(None).cast("string")).otherwise(src).alias(c))
        else:
            cols.append(_q(c))
    return df.select(*cols)


# ---------------------------------------------------------------- C06
MERGED_DATE = "date"  # fixed value


def dmy_columns(columns) -> tuple[str, str, str] | None:
    low = {c.lower(): c for c in reversed(list(columns))}
    if all(k in low for k in ("jour", "mois", "an")):
        return low["jour"], low["mois"], low["an"]
    return None


# ---------------------------------------------------------------- C16
def rename_map(prof_rows) -> dict:
    """P06 names for every non-id column, collisions suffixed ``_2``, ``_3`` in
    schema order: the first suffix that neither a kept id column, nor another
    column's proposed name, nor a name given before has.  ``date`` is kept for
    the column that day, month and year columns are merged into."""
    rows = sorted(prof_rows, key=lambda r: r["ordinal"])
    given = {r["column"].lower() for r in rows if r["data_type"] == "id"}
    if dmy_columns(r["column"] for r in rows):
        given.add(MERGED_DATE)
    wanted = {(r["proposed_name"] or r["column"]).lower() for r in rows if r["data_type"] != "id"}
    out = {}
    for r in rows:
        if r["data_type"] == "id":
            continue  # id columns keep their name and values
        name = base = r["proposed_name"] or r["column"]
        k = 1
        while name.lower() in given or (k > 1 and name.lower() in wanted):
            k += 1
            name = f"{base}_{k}"
        given.add(name.lower())
        out[r["column"]] = name
    return out


def cleaner_for(dtype: str, family: str, col: str, mode: str = "full"):
    c = _q(col)
    if dtype == "number":
        if family == "numeric":
            d = c.cast("double")
            return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
        return N.clean_number_basic(c)
    if dtype == "date":
        return D.to_datetime(c, "timestamp" if family == "temporal" else "string")
    if dtype == "category":
        if mode == "trim":
            return T.strip_ws(c.cast("string"))
        return T.normalize_category(c)
    return c


def clean_table(df: DataFrame, prof_rows, rename: bool = True, mode: str = "full",
                types: dict | None = None) -> DataFrame:
    """Typed cleaning of every column + rename, as one projection.

    ``types`` overrides the profile's ``data_type`` per column (C17/C18).
    Day/month/year columns are merged into ``date`` (originals kept), and the
    ``etat``/``note`` shift is repaired first (C15, clean-time rule)."""
    df = realign(df, "etat", "note", "^[A-Za-z]")
    prof = {r["column"]: r for r in prof_rows}
    types = types or {}
    names = rename_map(prof_rows) if rename else {}
    cols = []
    for c in df.columns:
        r = prof.get(c)
        if r is None:
            cols.append(_q(c))
            continue
        dtype = types.get(c, r["data_type"])
        expr = cleaner_for(dtype, r["family"], c, mode) if dtype != "id" else _q(c)
        cols.append(expr.alias(names.get(c, c)))
    dmy = dmy_columns(df.columns)
    out = df.select(*cols)
    if dmy:
        merged = D.merge_day_month_year(*dmy).cast("timestamp")
        # a kept id, a column without a profile or one that is not renamed may hold the name already
        k, name = 1, MERGED_DATE
        while name in {c.lower() for c in out.columns}:
            k += 1
            name = f"{MERGED_DATE}_{k}"
        out = df.select(*cols, merged.alias(name))
    return out


# ---------------------------------------------------------------- C17 / C18
def accept_proposals(proposals: DataFrame, policy: str = "auto", threshold: float | None = None) -> DataFrame:
    """C17: ``auto`` accepts proposals with confidence >= 0.7, ``fix_all``
    accepts all; a refused column keeps its name and becomes ``text``."""
    t = AUTO_ACCEPT if threshold is None else threshold
    ok = F.lit(True) if policy == "fix_all" else (F.col("confidence") >= F.lit(t))
    return proposals.withColumn("accepted", ok).withColumn(
        "final_name", F.when(ok, F.col("proposed_name")).otherwise(F.col("column"))
    ).withColumn("final_type", F.when(ok, F.col("data_type")).otherwise(F.lit("text")))


def apply_overrides(proposals: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(column, name, type)`` (either may be NULL) win over
    the proposals.  One row per column on both sides; a table of overrides that grows is joined as any other."""
    o = overrides.select("column", F.col("name").alias("_on"), F.col("type").alias("_ot"))
    return proposals.join(o, "column", "left").withColumn(
        "proposed_name", F.coalesce("_on", "proposed_name")).withColumn(
        "data_type", F.coalesce("_ot", "data_type")).drop("_on", "_ot")


# ---------------------------------------------------------------- C19
def drop_empty_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows where every column (or any of ``subset``) is NULL."""
    if subset:
        return df.na.drop(how="any", subset=list(subset))
    return df.na.drop(how="all")


# ---------------------------------------------------------------- C10-C14 inside C16
def apply_dictionaries(df: DataFrame, prof_rows, dictionary: DataFrame | None = None,
                       references: DataFrame | None = None) -> DataFrame:
    """The richer cleaning pass for category columns: a column with entries in
    ``dictionary(column, variant, canonical)`` gets exact + fuzzy correction
    (C10/C11); otherwise a column whose name marks it strict (C14) is mapped
    onto ``references(column, canonical, variant, ord)`` (C12, default: the
    known canonical lists C13), unknown values becoming NULL.  Each step works
    on distinct values and joins back (see ``fuzzy``)."""
    from . import fuzzy as Z

    refs = references if references is not None else Z.known_categories_df(df.sparkSession)
    dict_cols = set()
    if dictionary is not None:
        dict_cols = {r[0] for r in dictionary.select("column").distinct().collect()}
    ref_cols = {r[0] for r in refs.select("column").distinct().collect()}
    for r in sorted(prof_rows, key=lambda r: r["ordinal"]):
        c = r["column"]
        if r["data_type"] != "category" or c not in df.columns:
            continue
        if c in dict_cols:
            df = Z.correct_exact_fuzzy(df, c, dictionary)
        elif Z.is_strict_column(c) and c.lower() in ref_cols:
            df = Z.reference_categories(df, c, refs.withColumn("column", F.lower("column")).filter(
                F.col("column") == c.lower()).withColumn("column", F.lit(c)), strict=True)
    return df

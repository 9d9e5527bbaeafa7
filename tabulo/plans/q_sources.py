"""Registered queries: landing zones of files written from the given tables and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.profile import profile
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from .q_profile import SCHEMAS, _profile_sql
from .registry import query, table

PER_DOCUMENT = 500  # rows of one JSON document


def _folder(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


NOTES = {
    "quoted": "CASE c_custkey % 3 WHEN 0 THEN concat('line one', chr(10), 'line \"two\" of ', CAST(c_custkey AS STRING)) WHEN 1 THEN 'a;b' ELSE 'plain' END",
    "latin": "concat('Éléonore n° ', CAST(c_custkey AS STRING))",
    "document": "concat('brace } and { bracket [', CAST(c_custkey % 5 AS STRING))",
    "columns": "CASE WHEN c_custkey % 4 > 0 THEN concat('cell, \"', CAST(c_custkey AS STRING), '\"') END",
}


@query("landing_zone", " UNION ALL ".join(f"SELECT '{form}' AS form, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, {note.replace('AS STRING', 'AS VARCHAR')} AS note FROM customer" for form, note in NOTES.items()))
def landing_zone(spark, sf):
    """Delimited files whose quoted records span lines, ISO-8859-1 files, JSON documents over many lines and column-wise
    JSON, each written from all customers and read with everything sniffed."""
    c = table(spark, sf, "customer")
    rows = {form: c.selectExpr("c_custkey AS id", "c_name AS name", f"{note} AS note", f"CAST(floor(c_custkey / {PER_DOCUMENT}) AS BIGINT) AS part") for form, note in NOTES.items()}
    at = {form: _folder(spark, form) for form in NOTES}
    FS.write_table(rows["quoted"].drop("part"), at["quoted"])
    rows["latin"].drop("part").write.option("header", True).option("encoding", "ISO-8859-1").csv(at["latin"])
    # one document a part, of PER_DOCUMENT rows at most
    document = F.regexp_replace(F.to_json(F.collect_list(F.struct("id", "name", "note"))), r'\},\{"id"', '},\n  {"id"')
    cells = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.col(c).cast("string")))).alias(c)
    of_columns = F.to_json(F.struct(*(cells(c) for c in ("id", "name", "note"))), {"ignoreNullFields": "false"})
    for form, text in (("document", document), ("columns", of_columns)):
        rows[form].groupBy("part").agg(text.alias("value")).repartition("part").write.partitionBy("part").text(at[form])
    out = None
    for form in NOTES:
        back = FS.read_any(spark, at[form], fmt="csv" if form in ("quoted", "latin") else "json")
        back = back.select(F.lit(form).alias("form"), *(F.col(x).cast("string").alias(x) for x in ("id", "name", "note")))
        out = back if out is None else out.unionByName(back)
    return out


GROUP = "CASE WHEN c_custkey < 20 THEN 'tiny' ELSE concat('g', CAST(c_custkey % 7 AS STRING)) END"


@query("landing_files", f"""
SELECT g, CAST(sum(octet_length(encode(c_name)) + 1) AS BIGINT) AS size_bytes, round(sum(octet_length(encode(c_name)) + 1) / (1024 * 1024), 3) AS size_mb,
       sum(octet_length(encode(c_name)) + 1) / (1024 * 1024) >= 0.001 AS valid,
       CASE WHEN sum(octet_length(encode(c_name)) + 1) / (1024 * 1024) < 0.001 THEN 'empty file' ELSE 'OK' END AS reason
FROM (SELECT {GROUP.replace('AS STRING', 'AS VARCHAR')} AS g, c_name FROM customer) GROUP BY g""")
def landing_files(spark, sf):
    """One text file a group of customers, listed and judged."""
    at = _folder(spark, "files")
    table(spark, sf, "customer").selectExpr(f"{GROUP} AS g", "c_name AS value").repartition("g").write.partitionBy("g").text(at)
    listed = FS.list_files(spark, at, glob="*.txt").select("path", "size_bytes", "size_mb")
    judged = FS.validate_files(spark, at).select("path", "valid", "reason")
    g = F.regexp_extract("path", "/g=([^/]+)/", 1).alias("g")
    return listed.join(judged, "path").select(g, "size_bytes", "size_mb", "valid", "reason")


@query("preview_rows", "SELECT * FROM orders LIMIT 5")
def preview_rows(spark, sf):
    return FS.preview(table(spark, sf, "orders"), 5)


@query("report_roundtrip", " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, column_name, ordinal, n_rows, nulls, nunique, data_type, role FROM ({_profile_sql('lineitem', SCHEMAS['lineitem'])})" for fmt in ("json", "parquet")))
def report_roundtrip(spark, sf):
    """A profile written as JSON and as Parquet and read again."""
    found = profile(table(spark, sf, "lineitem")).select(F.col("column").alias("column_name"), F.col("ordinal").cast("int"), "n_rows", F.col("nulls").cast("long"), F.col("nunique").cast("long"), "data_type", "role")
    out = None
    for fmt in ("json", "parquet"):
        at = _folder(spark, "report")
        FS.write_report(found, at, fmt)
        back = FS.read_any(spark, at, fmt=fmt).select(F.lit(fmt).alias("format"), "column_name", F.col("ordinal").cast("int").alias("ordinal"), "n_rows", "nulls", "nunique", "data_type", "role")
        out = back if out is None else out.unionByName(back)
    return out

"""File sources and sinks.

* S01 ``read_any``: dispatch on the suffix (csv, tsv/txt, json, parquet);
  directories and globs work as in ``spark.read``.  Delimited text is read
  ALL-STRING (no ``inferSchema`` pass) and typed later by the profile.
* S02/S03 sniffing is distributed over many files: the first line of every
  file is taken from its first split only (``_metadata.file_block_start =
  0``), the separator is counted with native string functions, and files are
  grouped by (separator, encoding, header, record form) so each group is read
  once.  A record may span lines: whether one does is decided for each file by
  the parity of the quotes in its lines, added up over all splits; only such
  files are read record by record in one task each, all others stay splittable.
* JSON: Lines, one top-level array, one document over many lines, and the
  column-wise document (``{"a": {"0": 1, ...}, ...}`` or ``{"a": [1, ...], ...}``),
  which is turned into rows.
* S06/S07 list a landing zone with the ``binaryFile`` source, content column
  pruned (only path, length, modification time are read).
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import qcol

# Separator candidates in tie-break order.
SEPARATORS = [",", ";", "\t", "|", " "]
# Accepted extensions and size bounds of the upload check.
ACCEPTED_EXTENSIONS = [".csv", ".xlsx", ".xls", ".json", ".parquet", ".tsv", ".txt"]
MAX_MB = 200
MIN_MB = 0.001


def suffix(path: str) -> str:
    base = path.rstrip("/").lower()
    for ext in (".csv", ".tsv", ".txt", ".json", ".parquet"):
        if base.endswith(ext) or base.endswith(ext + "/") or (ext + "/") in base or base.endswith("*" + ext):
            return ext
    return os.path.splitext(base)[1]


def separator_expr(line) -> F.Column:
    """Candidate with the strictly largest count; ties keep list order; none -> ','."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(s), F.lit(""))) for s in SEPARATORS]
    best, best_n = F.lit(","), F.lit(0)
    for s, n in zip(SEPARATORS, counts):
        take = n > best_n
        best = F.when(take, F.lit(s)).otherwise(best)
        best_n = F.when(take, n).otherwise(best_n)
    return best


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, at, value): the lines of all files; ``at`` gives their order within a file."""
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos")).alias("at")
    return spark.read.options(**options).text(path).select(F.col("_metadata.file_path").alias("file"), at, "value")


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, first_line, sep, encoding, spans) for every file under ``path``.

    All lines of a file are looked at, in all of its splits: the first one
    names the separator, and any line that is not valid UTF-8
    (``try_validate_utf8`` is NULL) makes the file ISO-8859-1 (S03: latin-1
    decodes anything, so the reference's later fallbacks are never reached
    for encoding errors).  ``spans``: some line leaves a quote open, that is, it
    has an odd number of quotes (the state after a line is the state before it
    plus that parity, so the first odd line opens one).  One row per file, summed
    up by each task first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per_file = _lines(spark, path).groupBy("file").agg(
        F.min_by(F.when((F.col("at.start") == 0), F.col("value")), "at").alias("first_line"),
        F.max(F.try_validate_utf8("value").isNull()).alias("bad_utf8"), F.max(quotes % 2 == 1).alias("spans"))
    return per_file.select(
        "file", "first_line", separator_expr(F.col("first_line")).alias("sep"),
        F.when(F.col("bad_utf8"), F.lit("ISO-8859-1")).otherwise(F.lit("UTF-8")).alias("encoding"), "spans")


def json_forms(spark: SparkSession, path: str) -> DataFrame:
    """(file, form) for every JSON file: ``lines`` (several lines, the first one an object), ``columns`` (one object whose values
    are all objects, or all arrays) or ``document`` (one array or object over any number of lines)."""
    lines = _lines(spark, path).filter(F.trim("value") != "")
    per_file = lines.groupBy("file").agg(F.min_by(F.trim("value"), "at").alias("first"), F.count(F.lit(1)).alias("n"))
    is_object = F.col("first").startswith("{")
    many = per_file.select("file", F.when(is_object & (F.col("n") > 1) & F.try_parse_json("first").isNotNull(), F.lit("lines")).when(~is_object, F.lit("document")).alias("form"))
    # one object: its values tell a column-wise document from a row; such a document is one value by its nature
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    one = many.filter("form IS NULL").join(whole, "file")
    values = F.map_values(F.from_json("value", "map<string,string>"))
    all_of = lambda mark: F.forall(values, lambda x: F.trim(x).startswith(mark))
    columns = (F.size(values) > 0) & (all_of("{") | all_of("["))
    return many.filter("form IS NOT NULL").union(one.select("file", F.when(columns, F.lit("columns")).otherwise(F.lit("document"))))


def _column_wise(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of column-wise documents: a cell goes to the row of its index within its document.  Cells come as text, like those of
    delimited files; the profile types them."""
    docs = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.from_json("value", "map<string,string>")).alias("column", "cells"))
    listed = F.from_json("cells", "array<string>")
    keyed = F.from_json("cells", "map<string,string>")
    of_list = F.transform(listed, lambda x, i: F.struct(i.cast("string").alias("at"), x.alias("value")))
    of_map = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("at"), e["value"].alias("value")))
    cells = docs.select("file", "column", F.explode(F.when(F.trim("cells").startswith("["), of_list).otherwise(of_map)).alias("c")).select("file", "column", "c.at", "c.value")
    names = [r[0] for r in docs.select("column").distinct().orderBy("column").collect()]  # the columns of the table
    return cells.groupBy("file", "at").agg(*(F.max(F.when(F.col("column") == n, F.col("value"))).alias(n) for n in names)).drop("file", "at")


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    forms: dict[str, list[str]] = {}
    for r in json_forms(spark, path).orderBy("file").collect():  # one row a file, as Spark's own file list
        forms.setdefault(r["form"], []).append(unquote(r["file"]))
    frames = [_column_wise(spark, files) if form == "columns" else spark.read.option("multiLine", form == "document").json(files) for form, files in sorted(forms.items())]
    return _stacked(frames) if frames else spark.read.json(path)


def read_any(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None,
             encoding: str | None = None, header: bool = True) -> DataFrame:
    """S01 + S04: load a table; delimited text all-string with a header."""
    ext = fmt or suffix(path)
    if ext in (".parquet", "parquet"):
        return spark.read.parquet(path)
    if ext in (".json", "json"):
        return _read_json(spark, path)
    if ext in (".tsv", ".txt", "tsv") and sep is None:
        sep = "\t"
    groups: dict[tuple, list[str]] = {}
    # files of one separator, encoding, record form and header line are read together; unlike headers are matched by name
    for r in sniff_files(spark, path).orderBy("file").collect():  # one row a file, as Spark's own file list
        key = (sep or r["sep"], encoding or r["encoding"], bool(r["spans"]), r["first_line"] if header else None)
        groups.setdefault(key, []).append(unquote(r["file"]))
    frames = [spark.read.option("header", header).option("sep", s).option("encoding", e).option("multiLine", spans)
              .option("quote", '"').option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE").csv(files)
              for (s, e, spans, _), files in (groups or {(sep or ",", encoding or "UTF-8", False, None): [path]}).items()]
    return _stacked(frames)


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name; a column that they type differently is text."""
    types: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            types.setdefault(field.name.lower(), set()).add(field.dataType.simpleString())
    out = None
    for f in frames:
        same = f.select(*(qcol(c).cast("string").alias(c) if len(types[c.lower()]) > 1 else qcol(c) for c in f.columns))
        out = same if out is None else out.unionByName(same, allowMissingColumns=True)
    return out


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows (a limit pushed to the first splits)."""
    return df.limit(n)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, size_bytes, size_mb, modified) -- file content is never read."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.col("length").alias("size_bytes"),
                               F.round(F.col("length") / (1024 * 1024), 3).alias("size_mb"),
                               F.col("modificationTime").alias("modified"))


def validate_files(spark: SparkSession, path: str, max_mb: float = MAX_MB) -> DataFrame:
    """Accepted-input audit of a landing zone -> (path, valid, reason)."""
    files = list_files(spark, path)
    low = F.lower("path")
    ext_ok = F.lit(False)
    for e in ACCEPTED_EXTENSIONS:
        ext_ok = ext_ok | low.endswith(e)
    mb = F.col("size_bytes") / (1024 * 1024)
    reason = (F.when(~ext_ok, F.lit("invalid format"))
              .when(mb > max_mb, F.lit("file too large"))
              .when(mb < MIN_MB, F.lit("empty file"))
              .otherwise(F.lit("OK")))
    return files.select("path", "size_bytes", (reason == "OK").alias("valid"), reason.alias("reason"))


def write_table(df: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """Cleaned table as CSV with a header (``;`` separator); quotes inside values are doubled, as ``read_any`` expects."""
    df.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Profile / rename map / anomaly tables as JSON or Parquet (re-readable)."""
    w = df.write.mode(mode)
    (w.json(path) if fmt == "json" else w.parquet(path))

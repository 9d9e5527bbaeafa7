"""The long frequency table shared by profiling and scoring.

``freq(df) -> (ordinal, column, key, n, is_num, is_date)``: every column
rendered as text (NaN -> NULL), unpivoted and counted by a 128-bit key of the
text.  The texts themselves are never grouped, sorted or shuffled, however long
they are: an entry is some 60 bytes.  One shuffle; map-side partial aggregation
collapses repeated values before the exchange, so a hot value holding a third
of the rows costs one row per map task, not a third of the data.  The NULL
value is its own group (a null key).  ``values_of`` looks the texts of a few
keys up again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DoubleType, FloatType, MapType, NumericType, StructType, TimestampNTZType, TimestampType

from ..functions.numbers import NUM_RE
from ..functions.text import qcol

DATE_SHAPE_RE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"


def type_family(dt) -> str:
    if isinstance(dt, BooleanType):
        return "boolean"
    if isinstance(dt, NumericType):
        return "numeric"
    if isinstance(dt, (DateType, TimestampType, TimestampNTZType)):
        return "temporal"
    return "string"


def value_text(df: DataFrame, col: str) -> Column:
    """Text rendering used by the frequency table (NaN is NULL)."""
    dt = df.schema[col].dataType
    c = qcol(col)
    if isinstance(dt, (DoubleType, FloatType)):
        c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c.cast("string")


def value_key(text: Column) -> Column:
    """128 bits of a text; NULL of NULL.  Ties between equally frequent values go by it."""
    return F.unhex(F.md5(text))


def looks_numeric(text: Column) -> Column:
    """The exact shape test, run only where the first character and the cast allow it: no regex over long texts."""
    first = F.substring(F.ltrim(text, F.lit(" \t\n\x0b\f\r")), 1, 1)
    return F.when(first.isin(*"+-.0123456789") & text.try_cast("double").isNotNull(), text.rlike(NUM_RE)).otherwise(F.lit(False))


def looks_dated(text: Column) -> Column:
    return F.when(F.octet_length(text) <= 10, text.rlike(DATE_SHAPE_RE)).otherwise(F.lit(False))


def profilable(df: DataFrame, cols=None) -> list[str]:
    """Nested and binary columns are passed through, not profiled."""
    cols = cols or df.columns
    return [c for c in cols if not isinstance(df.schema[c].dataType, (StructType, ArrayType, MapType, BinaryType))]


def freq(df: DataFrame, cols=None) -> DataFrame:
    cols = profilable(df, cols)
    if not cols:
        raise ValueError("no profilable columns")

    def cell(i, c):
        text = value_text(df, c)
        shaped = type_family(df.schema[c].dataType) == "string"  # shapes only matter for text
        return F.struct(F.lit(i).alias("ordinal"), value_key(text).alias("key"),
                        (looks_numeric(text) if shaped else F.lit(False)).alias("is_num"), (looks_dated(text) if shaped else F.lit(False)).alias("is_date"))

    cells = df.select(F.explode(F.array(*(cell(i, c) for i, c in enumerate(cols)))).alias("cell")).select("cell.*")
    counted = cells.groupBy("ordinal", "key").agg(F.count(F.lit(1)).alias("n"), F.max("is_num").alias("is_num"), F.max("is_date").alias("is_date"))
    names = F.array(*(F.lit(c) for c in cols))
    return counted.select("ordinal", names[F.col("ordinal")].alias("column"), "key", "n", "is_num", "is_date")


def values_of(df: DataFrame, keys: DataFrame, cols=None) -> DataFrame:
    """(ordinal, key, value) of a few keys (ordinal, key): one more pass that keeps only their cells."""
    cols = profilable(df, cols)
    wanted = F.broadcast(keys.select("ordinal", "key"))  # the caller's bound: a few keys a column
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), value_text(df, c).alias("value")) for i, c in enumerate(cols)))).alias("cell")
    found = df.select(cells).select("cell.*").withColumn("key", value_key(F.col("value"))).join(wanted, ["ordinal", "key"])
    # one row a key and task before anything moves
    return found.groupBy("ordinal", "key").agg(F.first("value").alias("value"))

"""Cross products of many columns in one pass.

Every task keeps, for all pairs of columns, the number of rows that have both values, their sums, squares and products: four
matrix products per batch (``M'M``, ``X'M``, ``X*X'M``, ``X'X`` with X the values, 0 where null, and M the mask), added up over
the batches.  A task hands out one row per pair and Spark adds the rows of all tasks.  Values are taken as distances
from a pivot, a value of the column itself, so that large means do not swallow small variances.  Columns go in
blocks of BLOCK, so a task holds a few blocks' matrices whatever the width.

Nulls (and NaN) count pairwise; infinite values are counted apart and make their pairs' results NaN.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns whose products are one matrix
BLOCK = 256
#: rows that pivots are taken from; any value near the data will do
PIVOT_ROWS = 1000
#: a variance below this share of the mean square is rounding error of a constant
ROUNDING = 1e-13

_CELLS = ["n", "sx", "sy", "sxx", "syy", "sxy", "odd"]
_SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in _CELLS)


def _summing(pivots: list[float]):
    k = len(pivots)
    blocks = [(a, b) for a in range(0, k, BLOCK) for b in range(a, k, BLOCK)]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lambda a, b: (7, min(BLOCK, k - a), min(BLOCK, k - b))
        total = {at: np.zeros(shape(*at)) for at in blocks}
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            mask, odd = (~np.isnan(x)).astype(float), np.isinf(x)
            x = np.where(mask.astype(bool) & ~odd, x - pivots, 0.0)
            any_odd, odd, square = odd.any(), odd.astype(float), x * x
            for (a, b), t in total.items():
                u, v = slice(a, a + BLOCK), slice(b, b + BLOCK)
                t[0] += mask[:, u].T @ mask[:, v]
                t[1] += x[:, u].T @ mask[:, v]
                t[2] += mask[:, u].T @ x[:, v]
                t[3] += square[:, u].T @ mask[:, v]
                t[4] += mask[:, u].T @ square[:, v]
                t[5] += x[:, u].T @ x[:, v]
                if any_odd:
                    t[6] += odd[:, u].T @ mask[:, v] + mask[:, u].T @ odd[:, v]
        if seen:
            for (a, b), t in total.items():
                i, j = np.indices(t.shape[1:])
                keep = (i + a) < (j + b)
                arrays = [pa.array((i + a)[keep].astype(np.int32)), pa.array((j + b)[keep].astype(np.int32)), *(pa.array(c[keep]) for c in t)]
                yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *_CELLS])

    return add_up


def cross_products(df: DataFrame, values) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, odd) for every pair i < j of `values` (double columns): sums over the rows that
    have both, as distances from the pivots."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no package install
    numbers = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    some = numbers.limit(PIVOT_ROWS).toArrow()
    pivots = []
    for c in some.columns:
        x = c.to_numpy(zero_copy_only=False).astype(float)
        x = np.sort(x[np.isfinite(x)])
        pivots.append(float(x[len(x) // 2]) if len(x) else 0.0)
    cells = numbers.mapInArrow(_summing(pivots), _SCHEMA)
    return cells.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in _CELLS))


def correlations(df: DataFrame, names: list[str], values) -> DataFrame:
    """(c1, c2, r, n) for every pair in the order of `names`; r is NULL where a column does not vary or no row has both."""
    found = cross_products(df, values)
    name = F.array(*(F.lit(c) for c in names))
    k = len(names)
    pairs = df.sparkSession.range(k).select(F.col("id").cast("int").alias("i"))
    pairs = pairs.select("i", F.explode(F.expr(f"CASE WHEN i + 1 < {k} THEN sequence(i + 1, {k - 1}) ELSE array() END")).alias("j"))
    n = F.greatest(F.col("n"), F.lit(1.0))
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / n
    varies = lambda s, q: spread(s, q) > ROUNDING * F.col(q)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    r = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(varies("sx", "sxx") & varies("sy", "syy"), r)
    full = pairs.join(found, ["i", "j"], "left")  # a table without rows has its pairs too
    return full.select(name[F.col("i")].alias("c1"), name[F.col("j")].alias("c2"), r.alias("r"), F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))

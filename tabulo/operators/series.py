"""Rolling series and the monotonic test.

A plain ``Window.orderBy`` puts a whole series in one task -- the global
series, or any series key holding a large share of the rows.  Both are run
with one plan instead:

1. ``repartitionByRange`` on the order key, sort within partitions, tag each
   row with its partition id and position, and ``checkpoint()`` (written to
   the shared ``spark.checkpoint.dir``) so every later pass sees the same
   partitions even if executors are lost;
2. per-partition row counts -> prefix offsets (the only collect: one number
   per partition) -> a dense global row index;
3. rows are cut into chunks of ``B`` rows; the last ``w-1`` rows of each
   chunk are copied into the next one, the window runs partitioned by
   (series key, chunk) and the copies are dropped.  Identical to the plain
   window; a key with a third of the rows spans many chunks.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .agg import _num, _q

TARGET_CHUNK_ROWS = 2_000_000


def global_index(df: DataFrame, order_cols, partitions: int | None = None) -> DataFrame:
    """Dense 0-based row index ``_idx`` in (order_cols) order, computed without a single-task sort."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [_q(c) for c in order_cols]
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(p, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
        .checkpoint(eager=True)
    )
    counts = sorted((r["_pid"], r["n"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = {}, 0
    for pid, n in counts:
        offsets[pid] = acc
        acc += n
    starts = spark.createDataFrame(list(offsets.items()), "_pid int, _before long")  # one row a partition
    return ranged.join(F.broadcast(starts), "_pid").withColumn("_idx", F.col("_before") + F.col("_pos")).drop("_pid", "_pos", "_before")


def index_within(df: DataFrame, group_cols, order_cols, partitions: int | None = None) -> DataFrame:
    """``_idx`` (global dense index in (group, order) order), ``_k`` (0-based
    position inside the group) and ``_n`` (group size), without a window per
    group: a group holding a third of the rows is still spread over tasks.
    Per-group start and size come from one aggregate joined back (one row
    per group)."""
    g = list(group_cols)
    indexed = global_index(df, g + [c for c in order_cols if c not in g], partitions)
    starts = indexed.groupBy(*[_q(c) for c in g]).agg(F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_n"))
    held = [f"_g{i}" for i in range(len(g))]  # a NULL key is a group like any other
    starts = starts.withColumnsRenamed(dict(zip(g, held)))
    same = [_q(c).eqNullSafe(F.col(h)) for c, h in zip(g, held)]
    return indexed.join(starts, reduce(Column.__and__, same)).withColumn("_k", F.col("_idx") - F.col("_start")).drop("_start", *held)


def _chunked(indexed: DataFrame, lookback: int, n_rows: int, chunk_rows: int | None = None) -> DataFrame:
    b = chunk_rows or max(lookback + 1, min(TARGET_CHUNK_ROWS, math.ceil(max(n_rows, 1) / 8)))
    base = indexed.withColumn("_chunk", F.floor(F.col("_idx") / b)).withColumn("_copy", F.lit(False))
    if lookback <= 0:
        return base
    tail = (indexed.filter((F.col("_idx") % b) >= b - lookback)
            .withColumn("_chunk", F.floor(F.col("_idx") / b) + 1).withColumn("_copy", F.lit(True)))
    return base.unionByName(tail)


def rolling(df: DataFrame, order_col: str, value_col: str, partition_cols=(), tiebreak=(),
            mean_window: int = 10, band_window: int = 5, smooth_above: int = 100, band_above: int = 10,
            chunk_rows: int | None = None) -> DataFrame:
    """W01 + W02 (+T01): series sorted by ``order_col``; ``rolling_mean`` is the
    trailing mean of ``mean_window`` rows when the series has more than
    ``smooth_above`` rows (else the raw value); ``band_min``/``band_max`` the
    trailing min/max of ``band_window`` rows when it has more than
    ``band_above`` rows (else NULL)."""
    keys = list(partition_cols)
    order = [order_col] + [c for c in tiebreak if c != order_col]
    data = df.select(*[_q(c) for c in dict.fromkeys(keys + order)], _num(value_col).alias("_v")).filter(
        _q(order_col).isNotNull() & F.col("_v").isNotNull())
    lookback = max(mean_window, band_window) - 1
    if keys:
        # skew-proof: no window over a whole series key; the dense index runs
        # over (keys, order) and the chunks never mix keys
        indexed = index_within(data, keys, [*order, "_v"])  # the value last: equal rows are all that can tie
        n_rows = indexed.count()
        out = _chunked(indexed, lookback, n_rows, chunk_rows)
        w = Window.partitionBy(*[_q(c) for c in keys], "_chunk").orderBy("_idx")
    else:
        indexed = global_index(data, [*order, "_v"])
        n_rows = indexed.count()
        out = _chunked(indexed, lookback, n_rows, chunk_rows).withColumn("_n", F.lit(n_rows))
        out = out.withColumn("_k", F.col("_idx"))
        w = Window.partitionBy("_chunk").orderBy("_idx")
    wm = w.rowsBetween(-(mean_window - 1), 0)
    wb = w.rowsBetween(-(band_window - 1), 0)
    out = (
        out.withColumn("rolling_mean", F.when(F.col("_n") > smooth_above, F.avg("_v").over(wm)).otherwise(F.col("_v")))
        .withColumn("band_min", F.when(F.col("_n") > band_above, F.min("_v").over(wb)))
        .withColumn("band_max", F.when(F.col("_n") > band_above, F.max("_v").over(wb)))
    )
    out = out.filter(~F.col("_copy"))
    return out.select(*[_q(c) for c in dict.fromkeys(keys + order)], F.col("_k").alias("row_idx"),
                      F.col("_v").alias(value_col), "rolling_mean", "band_min", "band_max")


RUN = "part int, n bigint, first double, last double, rising boolean, falling boolean"


def _runs(batches):
    """The summary of one sorted partition: its first and last value, and whether it never falls or never rises."""
    part, n, first, last, rising, falling = None, 0, None, None, True, True
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(1).to_numpy(zero_copy_only=False)
        if n == 0:
            part, first = batch.column(0)[0].as_py(), float(v[0])
        else:
            v = np.append(last, v)
        steps = v[1:] >= v[:-1], v[1:] <= v[:-1]
        rising, falling = rising and bool(steps[0].all()), falling and bool(steps[1].all())
        n, last = n + batch.num_rows, float(v[-1])
    if n:
        yield pa.RecordBatch.from_pylist([dict(part=part, n=n, first=first, last=last, rising=rising, falling=falling)], schema=pa.schema(
            [("part", pa.int32()), ("n", pa.int64()), ("first", pa.float64()), ("last", pa.float64()), ("rising", pa.bool_()), ("falling", pa.bool_())]))


def is_monotonic(df: DataFrame, value_col: str, order_cols, min_values: int = 3) -> DataFrame:
    """Is ``value_col`` monotonic (non-decreasing or non-increasing) in ``order_cols`` order?

    One range exchange; every sorted partition becomes one summary (first, last, rising, falling, count), and the summaries --
    one row a partition -- are folded in order.  Rows of equal order keys go by value, so the result does not depend on the
    partitioning.  NULL values are dropped first."""
    spark = df.sparkSession
    # executors need no package install
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    order = list(dict.fromkeys(order_cols))
    data = df.select(*[_q(c).alias(f"_o{i}") for i, c in enumerate(order)], _num(value_col).alias("_v")).filter(F.col("_v").isNotNull())
    by = [*(f"_o{i}" for i in range(len(order))), "_v"]
    runs = data.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), "_v").mapInArrow(_runs, RUN)
    n, last, rising, falling = 0, None, True, True
    for r in sorted(runs.collect(), key=lambda r: r["part"]):
        if last is not None:
            rising, falling = rising and r["first"] >= last, falling and r["first"] <= last
        n, last, rising, falling = n + r["n"], r["last"], rising and r["rising"], falling and r["falling"]
    return spark.createDataFrame([(n, n >= min_values and (rising or falling), rising, falling)], "n long, monotonic boolean, increasing boolean, decreasing boolean")

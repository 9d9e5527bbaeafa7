"""Streaming cleaning (C16 on a streaming DataFrame).

The reference is batch only.  The row cleaners are row-local native
expressions, so the same ``clean_table`` projection runs unchanged on a
``readStream`` source: profile a bounded snapshot (or pass a stored
profile), then apply the projection to the stream and write it out with a
checkpoint under the shared ``spark.checkpoint.dir`` (exactly-once file
sink, restartable after executor or driver loss).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean_table
from ..session import ensure_checkpoint_dir


def clean_stream(stream: DataFrame, prof_rows, rename: bool = True) -> DataFrame:
    """The C16 projection on a streaming DataFrame (stateless, no shuffle)."""
    return clean_table(stream, prof_rows, rename=rename)


def run_clean_stream(spark: SparkSession, source_dir: str, schema, prof_rows, sink_dir: str,
                     fmt: str = "parquet", name: str = "clean_stream", once: bool = True):
    """Clean every file arriving in ``source_dir`` into ``sink_dir``."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    q = (clean_stream(src, prof_rows).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", ckpt).outputMode("append"))
    q = q.trigger(availableNow=True) if once else q
    return q.start()

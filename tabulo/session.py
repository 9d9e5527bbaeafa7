"""Session helpers: one place for the settings every operator relies on.

Operators never create sessions themselves; they take a DataFrame and return
a DataFrame.  ``get_spark`` is a convenience for tests, the bench and the
driver entry.  On a cluster the session comes from the platform and only the
SQL settings below are applied (they are session-scoped and safe to set).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library's semantics depend on (not tuning knobs):
#  * UTC so timestamp_ntz / date arithmetic is identical everywhere,
#  * ANSI on (Spark 4 default) -- the cleaners use try_* functions everywhere,
#  * AQE on so partition counts and skewed joins are re-planned at runtime.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SQL_SETTINGS.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tabulo") -> SparkSession:
    """Local/test session.  Keeps the web UI off (no server, no port)."""
    master = master or os.environ.get("TABULO_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TABULO_DRIVER_MEMORY", "4g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only a local session without it gets a scratch folder; on a cluster a
    machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        d = tempfile.mkdtemp(prefix="tabulo-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


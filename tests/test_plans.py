"""Physical-plan properties behind the scale claims (checked on executed AQE plans)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tabulo.operators import fuzzy as Z
from tabulo.operators import series as S
from tabulo.operators.profile import profile

from .conftest import SF_CHECK


def executed(df) -> str:
    """Final (AQE) physical plan of ``df`` after running it (outputs are small here)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_moves_only_partials(plan: str) -> bool:
    """Every SinglePartition exchange must carry partial-aggregate rows (one
    per task), never data rows as an unpartitioned window or sort would."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = next((x for x in lines[i + 1:] if x.strip()), "")
            if "partial_" not in nxt:
                return False
    return True


def test_rolling_and_monotonic_never_use_a_single_partition(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    for df in (S.rolling(ev, "ts", "value", tiebreak=["event_id"]),
               S.rolling(ev, "ts", "value", partition_cols=["event_type"], tiebreak=["event_id"]),
               S.is_monotonic(ev, "value", ["ts", "event_id"])):
        plan = executed(df)
        assert single_partition_moves_only_partials(plan), plan
    # the plain window the plan replaces does move all rows into one partition
    from pyspark.sql import Window
    naive = ev.select(F.avg("value").over(Window.orderBy("ts").rowsBetween(-9, 0)).alias("m"))
    assert not single_partition_moves_only_partials(executed(naive))


def test_flagship_prunes_and_preaggregates(spark):
    df = E.queries()["mean_revenue_by_segment"](spark, SF_CHECK)
    plan = executed(df)
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in formatted
    # orders are reduced per customer (partial + final aggregate) below the join
    join_at = max(plan.find("BroadcastHashJoin"), plan.find("SortMergeJoin"))
    assert join_at > 0 and plan.find("keys=[o_custkey", join_at) > join_at


def test_profile_reuses_the_frequency_table_exchange(spark):
    li = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    assert "ReusedExchange" in executed(profile(li))


def test_profile_shuffles_no_texts(spark):
    """Exchanges are dealt by ordinals and 16-byte keys; the values of the samples are the only texts that move."""
    import re

    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    plan = executed(profile(docs, ["text", "source"]))
    dealt = re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*)\)", plan)
    assert dealt and all(re.sub(r"#\d+L?", "", k.strip()) in {"ordinal", "key", "200", "8", "ENSURE_REQUIREMENTS"} or k.strip().isdigit() or k.strip().startswith("ENSURE") for d in dealt for k in d.split(",")), dealt
    assert not re.search(r"partitioning\([^)]*(value|text|source)#", plan)


def test_fuzzy_matching_has_no_nested_loop_join(spark):
    d = spark.createDataFrame([("c", "building", "Building"), ("c", "machinery", "Machinery")],
                              "column string, variant string, canonical string")
    cust = spark.read.parquet(f"{SF_CHECK}/customer.parquet").select(F.lower("c_mktsegment").alias("c"))
    plan = executed(Z.correct_exact_fuzzy(cust, "c", d))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_reference_categories_has_no_nested_loop_join(spark):
    refs = Z.known_categories_df(spark)
    df = spark.createDataFrame([("terminé",), ("Formation Terminée",), ("zzz",), ("expert confirmé",)],
                               "statut string")
    plan = executed(Z.reference_categories(df, "statut", refs, strict=True))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_profile_of_a_column_subset_prunes_the_scan(spark):
    import re

    li = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    p = profile(li, ["l_returnflag", "l_quantity"])
    p.collect()
    formatted = p._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schemas = set(re.findall(r"ReadSchema: (struct<[^\n]*>)", formatted))
    assert schemas, formatted
    for s in schemas:
        cols = set(re.findall(r"(\w+):", s))
        assert cols <= {"l_returnflag", "l_quantity"}, s


def test_clean_table_is_one_narrow_stage(spark):
    import re

    from tabulo.operators.clean import clean_table

    o = spark.read.parquet(f"{SF_CHECK}/orders.parquet")
    prof = profile(o).collect()
    plan = executed(clean_table(o, prof))
    exchanges = re.findall(r"Exchange (\w+)", plan)
    # the only exchange is the round-robin spread of a small input (absent at scale)
    assert set(exchanges) <= {"RoundRobinPartitioning"}, plan
    assert "Join" not in plan and "Aggregate" not in plan


def test_profile_top_values_limit_runs_before_the_exchange(spark):
    li = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    p = profile(li)
    p.collect()
    formatted = p._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = formatted.split("\n\n\n")[0].split("\n(1)")[0].splitlines()
    wgl = [i for i, x in enumerate(tree) if "WindowGroupLimit" in x]
    exch = [i for i, x in enumerate(tree) if "Exchange" in x]
    # going down the tree: final limit, then the exchange, then the partial limit under it
    assert any(a < e < b for a in wgl for e in exch for b in wgl), "\n".join(tree)

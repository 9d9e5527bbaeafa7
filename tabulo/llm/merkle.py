"""Merkle manifest of a data set (operator 12): sibling-shift self-joins, DataFrame functions only.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a group ascend by id; runs of ``arity`` nodes become
their hash, level by level, until one node, the subroot, is left.  The subroots, ordered by group, make the upper tree.

1. Places: the small rows (group, id, leaf) are dealt by range and sorted within their ranges, each row keeps its
   place there, and counts per range and group turn that into a place within the group.  A group that holds a third of
   all rows lies in many ranges; rows that are equal in everything are told apart by the partition that they were read in.
2. Every level equijoins its nodes with themselves on computed sibling places: place XOR 1 for two children,
   the other slots of the run otherwise.  A node learns the hashes to its left and right; slot-zero rows emit the parents.
3. From the top down, every node joins its parent's path, so the leaves get theirs: one (left, right) for each level.

The tables shrink by the arity a level.  Each level is written to the shared folder.  No window spans a group.

Edge cases: a null field counts as ``-``, a null group is a group and comes first, null ids come first within their group;
rows with the same group and id follow each other by leaf; a lone leaf is its group's subroot and a lone subroot the root;
a run may have fewer nodes, even one, and is hashed all the same; empty tables have no root and no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``i``, the place within the group (from 0), and ``n``, the size of the group."""
    by = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = rows.withColumn("_read", F.spark_partition_id())
    ranged = ranged.repartitionByRange(*by, F.col("_read")).sortWithinPartitions(*by)
    ranged = stored(ranged.drop("_read").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy(group, part).agg(F.count("*").alias("_m"), F.min("_at").alias("_first"))
    # one row for each range that holds rows of the group
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), "_part", "_first", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(whole).alias("n"))
    found = ranged.withColumn("_p", F.shiftright("_at", 33)).join(starts, (F.col(group) == F.col("_group")) & (F.col("_p") == F.col("_part")))
    return found.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_p", "_group", "_part", "_first", "_before")


def joined(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (g, i, h) with the digests of their run to the left and to the right, concatenated (empty where there are none)."""
    i, others, sides = F.col("i"), nodes.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("h").alias("_h")), []
    slot, run = F.pmod(i, F.lit(arity)), F.floor(i / arity).cast("long") * arity
    for shift in range(1, arity):
        place = i.bitwiseXOR(F.lit(1)) if arity == 2 else run + F.pmod(slot + shift, F.lit(arity))
        nodes = nodes.withColumn("_to", place).join(others, (F.col("g") == F.col("_g")) & (F.col("_to") == F.col("_i")), "left")
        nodes = nodes.drop("_g", "_i", "_to").withColumnRenamed("_h", f"_h{shift}")
        sides.append((F.pmod(slot + shift, F.lit(arity)), F.coalesce(f"_h{shift}", F.lit(""))))
    in_order = lambda keep: F.concat(F.lit(""), *(
        reduce(lambda e, x: F.when((x[0] == s) & keep(s), x[1]).otherwise(e), sides, F.lit("")) for s in range(arity)))
    out = nodes.withColumn("left", in_order(lambda s: F.lit(s) < slot)).withColumn("right", in_order(lambda s: F.lit(s) > slot))
    return out.drop(*(f"_h{s}" for s in range(1, arity)))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The slot-zero rows' parents."""
    first = level.where(F.pmod("i", F.lit(arity)) == 0)
    return first.select("g", F.floor(F.col("i") / arity).cast("long").alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"), digest(F.col("h"), F.col("right")).alias("h"))


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes (g, i, n, h, further columns) -> for each level the nodes of groups that go on, joined with their siblings, and
    for each level the groups that end there (g, h, further columns at level 0)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, ends = [], []
    while True:
        ends.append(nodes.where("n = 1").drop("i", "n"))
        if most <= 1:
            return levels, ends
        levels.append(stored(joined(nodes.where("n > 1"), arity)))
        nodes = parents(levels[-1], arity)
        most = -(-most // arity)


def descend(levels: list[DataFrame], ends: list[DataFrame], of_group: DataFrame, arity: int) -> DataFrame:
    """Level 0 of a forest with the columns of of_group (g, path, further ones), each path led by the node's own levels."""
    further = [c for c in of_group.columns if c not in ("g", "path")]
    at = lambda k: ends[k].select("g", *([] if k else [c for c in ends[0].columns if c != "g"])).join(of_group, "g")
    above = at(len(levels)).withColumn("i", F.lit(0).cast("long"))
    for k in reversed(range(len(levels))):
        up = above.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_path"), *(F.col(c).alias(f"_{c}") for c in further))
        kept = levels[0].columns if k == 0 else ["g", "i"]
        nodes = levels[k].join(up, (F.col("g") == F.col("_g")) & (F.floor(F.col("i") / arity) == F.col("_i")))
        own = F.concat(F.array(F.struct("left", "right")), F.col("_path"))
        nodes = nodes.select(*kept, own.alias("path"), *(F.col(f"_{c}").alias(c) for c in further))
        done = at(k).withColumn("i", F.lit(0).cast("long"))
        if k:
            above = stored(nodes.unionByName(done))
        else:
            return nodes.drop("n", "left", "right").unionByName(done)
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, run: digest(run["left"], h, run["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def manifest(leaves: DataFrame, arity: int = 3) -> DataFrame:
    """leaves (group, id, leaf, further columns) -> those columns with subroot, root and path (array of left and right, from
    the leaf to the root).  group is a string or null, id orders the leaves of a group; further columns may not be named g, h, i,
    n, left or right or like a column added here."""
    group = F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))  # null first, then bytewise
    rows = placed(stored(leaves.withColumn("g", group)), "g", ["id", "leaf"]).withColumn("h", F.col("leaf")).drop("group")
    levels, ends = climb(rows, arity)
    subroots = reduce(DataFrame.union, [e.select("g", "h") for e in ends])
    top = placed(subroots.select(F.col("g").alias("of"), "h", F.lit(0).alias("g")), "g", ["of"])
    top_levels, top_ends = climb(top.withColumn("subroot", F.col("h")), arity)
    root = top_ends[-1].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("h").alias("root"))
    upper = stored(descend(top_levels, top_ends, root, arity).select(F.col("of").alias("g"), "path", "subroot", "root"))
    found = descend(levels, ends, upper, arity)
    further = [c for c in leaves.columns if c != "group"]
    return found.select(F.expr("CASE WHEN g <> '' THEN substr(g, 2) END").alias("group"), *further, "subroot", "root", "path")


def document_manifest(docs: DataFrame, arity: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed_leaf) of documents; changed_leaf is the leaf after tampering: where 2 divides
    the crc32 of the id, the line feeds of the text are gone."""
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select(F.col("source").cast("string").alias("group"), F.col("doc_id").alias("id"), leaf(*head, text).alias("leaf"), leaf(*head, tampered).alias("changed_leaf"))
    return manifest(leaves, arity).withColumnRenamed("id", "doc_id")

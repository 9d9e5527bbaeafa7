"""Document fingerprints (operator 10): bottom-k sketches of shingle hashes.

A fingerprint holds the K smallest distinct 64-bit hashes of a text's five-word shingles (words are what
white space separates; a text of one to four words is one shingle), as ascending base64 of big-endian
integers.  Sketches of parts merge into the sketch of the whole.  From two sketches: resemblance (share of
the K smallest hashes of the union that both hold), containment and the number of distinct shingles; exact
where a text has fewer than K shingles.

Edge cases: null and empty texts have the empty fingerprint; two empty fingerprints have likeness 1, one
empty and one other 0; equal texts have equal fingerprints; repeated rows and repeated or null ids are
documents of their own, ordered by (doc_id, nulls first, then text).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, shingles, text_of, word_hashes

K = 128
SHINGLE = 5


def sketches(texts: list[bytes]):
    for words in word_hashes(texts):
        yield np.unique(shingles(words, SHINGLE))[:K]


def sketch(text: str) -> np.ndarray:
    return next(sketches([text.encode()]))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)[:K]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray) -> float:
    return float(len(a)) if len(a) < K else (K - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b) * distinct(merge(a, b)) / distinct(a))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def load(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), ">u8").astype(np.uint64)


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([dump(x) for x in sketches(as_bytes(texts))], pa.string())


def _pairwise(measure):
    @F.arrow_udf(T.DoubleType())
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([measure(load(x), load(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())
    return of


_resemblance, _containment = _pairwise(resemblance), _pairwise(containment)


@F.arrow_udf(T.DoubleType())
def _distinct(a: pa.Array) -> pa.Array:
    return pa.array([distinct(load(x)) for x in a.to_pylist()], pa.float64())


def fingerprint(text: Column) -> Column:
    return _fingerprint(F.coalesce(text, F.lit("")))


def estimated_resemblance(a: Column, b: Column) -> Column:
    return _resemblance(a, b)


def estimated_containment(a: Column, b: Column) -> Column:
    return _containment(a, b)


def estimated_distinct(a: Column) -> Column:
    return _distinct(a)


def merge_fingerprints(df: DataFrame, key: str, column: str = "fingerprint") -> DataFrame:
    """One fingerprint per key from those of its parts.  Each task first merges what it has read, so a
    hot key costs one sketch per task; then the sketches of a key merge in the same way."""
    schema = f"{df.select(key).schema[0].name} {df.schema[key].dataType.simpleString()}, {column} string"

    def fold(batches):
        held: dict = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = merge(held[k], load(s)) if k in held else load(s)
                if len(held) >= 20_000:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def packed(held):
        return pa.RecordBatch.from_pydict({key: pa.array(list(held), kind), column: [dump(v) for v in held.values()]})

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[key].dataType)
    parts = df.select(key, column).mapInArrow(fold, schema)
    # the per-task sketches of one key meet in one task: as many as there were tasks, K hashes each
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    once = salted.repartition(key, "_salt").drop("_salt").mapInArrow(fold, schema)
    gathered = once.groupBy(key).agg(F.collect_set(column).alias("_all"))  # 64 a key, K hashes each

    @F.arrow_udf("string")
    def united(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists.to_pylist():
            a = np.zeros(0, np.uint64)
            for s in row:
                a = merge(a, load(s))
            out.append(dump(a))
        return pa.array(out, pa.string())

    return gathered.select(key, united("_all").alias(column))


EDITS = "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edges_of(ends: list[float], hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and text hashes at which ranges begin, in order: at the quantiles of the ids, and in as many
    places of a hot id's hashes as it should have ranges."""
    lowest, highest = -(2**63), 2**63 - 1
    edges = {(min(int(e), highest), lowest) for e in ends}
    for k, parts in hot.items():
        edges |= {(k, lowest + i * (2**64 // parts)) for i in range(parts)}
    return tuple(np.array(x, np.int64) for x in zip(*sorted(edges or {(0, lowest)})))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document with its edited text (the last quarter replaced by the beginning of the next
    document in the order of doc_id; after the last comes the first), both fingerprints, and the likeness
    of its own to the edited text's and to the next document's.

    Rows of the same id follow by the hash of their text.  Documents are dealt out once, by ranges of doc_id and,
    for an id of more rows than two ranges should have, of the text hash; the ranges' ends come from quantiles
    of the ids (as many as four times the shuffle partitions), and the first document of every range also goes
    to the range before, so each task reads its documents in order and has the next one at hand.  Only exact copies
    of one text under one id stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / (4 * n) for i in range(1, 4 * n)], 1 / (8 * n))
    sizes = rows.groupBy("k").count()
    share = max(1, (sizes.agg(F.sum("count")).first()[0] or 0) // (4 * n))
    hot = {x.k: x["count"] // share for x in sizes.where(F.col("count") >= 2 * share).collect()}  # at most 4 n of two shares or more
    edge_k, edge_h = edges_of(ends, hot)
    inner = {k: edge_h[edge_k == k] for k in hot}

    @F.arrow_udf("int")
    def range_of(k: pa.Array, h: pa.Array) -> pa.Array:
        ids, hashes = k.to_numpy(zero_copy_only=False), h.to_numpy(zero_copy_only=False)
        out = np.searchsorted(edge_k, ids, side="right")
        for x in np.unique(ids):
            if int(x) in inner:
                at = ids == x
                out[at] = np.searchsorted(edge_k, x, side="left") + np.searchsorted(inner[int(x)], hashes[at], side="right")
        return pa.array(out.astype(np.int32))

    # the hash decides only for hot ids; without any, no text is read for the ranges
    of_hot = F.when(F.col("k").isin(list(hot)), F.xxhash64("text")) if hot else F.lit(None).cast("bigint")
    ranged = rows.withColumn("hot", of_hot).withColumn("r", range_of("k", F.coalesce("hot", F.lit(0).cast("bigint"))))
    firsts = [(x.r, *x.first) for x in ranged.groupBy("r").agg(F.min(F.struct("k", "hot")).alias("first")).orderBy("r").collect()]  # one row a range
    after = [(k, h, r) for (r, _, _), (_, k, h) in zip(firsts, firsts[1:] + firsts[:1])]
    heads = F.broadcast(spark.createDataFrame(after, "k bigint, first bigint, r int"))  # at most 12 n rows
    hashed = rows.withColumn("h", F.xxhash64("text"))
    lent = hashed.join(heads, "k").where("first IS NULL OR first = h").groupBy("r", "k").agg(F.min(F.struct("h", "text")).alias("x"))
    lent = lent.select(F.col("k").alias("doc_id"), "x.text", "k", "x.h", "r", F.lit(1).alias("lent"))
    dealt = ranged.select("doc_id", "text", "k", F.xxhash64("text").alias("h"), "r", F.lit(0).alias("lent")).unionByName(lent)
    dealt = dealt.repartition("r").sortWithinPartitions("r", "lent", "k", "h", "text").select("r", "lent", "doc_id", "text")

    def edits(batches):
        held = None  # (range, doc_id, text, sketch): the document whose next one is still to come
        for batch in batches:
            done = []  # (id, text, edited text, sketch, sketch of the next)
            for (r, lent, doc, text), own in zip(zip(*(c.to_pylist() for c in batch.columns)), sketches(as_bytes(batch.column(3)))):
                if held is not None:
                    _, held_doc, held_text, held_sketch = held
                    q = len(held_text) // 4
                    done.append((held_doc, len(held_text), held_text[:len(held_text) - q] + text[:q], held_sketch, own))
                held = None if lent else (r, doc, text, own)
            out = [(doc, n, edited, dump(mine), dump(changed), resemblance(mine, changed), resemblance(mine, own))
                   for (doc, n, edited, mine, own), changed in zip(done, sketches([x[2].encode() for x in done]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = [c.split()[0] for c in EDITS.split(", ")]
    return dealt.mapInArrow(edits, EDITS)

"""MinHash near-duplicates (operator 7): multi-index Hamming join of b-bit signatures.

A document is the set of its word shingles (words are what ASCII white space separates, A-Z lower-cased).  Its
signature has POSITIONS b-bit MinHash symbols.  Two sets of Jaccard j differ in a position with a
probability under 1 - j, so a link shows as a small signature distance.  Signatures are split into CHUNKS;
by the pigeonhole principle, two signatures within DISTANCE = 2 * CHUNKS - 1 positions have a chunk with at
most one differing symbol.  That error is enumerated: a chunk gives one key for each of its positions, with
the symbol there left out.  Every pair within DISTANCE therefore shares a key; at the thresholds used here
(0.8 and more) a link lies beyond it with a probability of at most 3.1e-4 (0.8) or 2.4e-6 (0.85), and is then lost
unless other links join the two.  All candidate
pairs are compared by signature, then on the full shingle sets.

Hot groups: equal sets collapse to one class first.  Within a key, members are compared with one hub per
key and round, not with each other; components found so drop out, and what is left between different
components of a key is compared pair by pair: the join itself compares sizes, signatures and parities and lets a
pair through only at the first key that both share, so that near copies below the threshold leave no rows.  The parity
of a set has one bit for each of PARITY buckets of its shingles: every bit in which two parities differ stands for a
shingle that only one of the sets has, so the bound on such shingles loses no link (it tells little apart in sets of
several thousand shingles).  No key is capped, no group is collected.

Edge cases: null, empty and white-space texts have an empty set, link with nothing and are their own
component; a text shorter than a shingle is one shingle; repeated rows are one class; rows with a null id
have component null unless they link with a row that has an id, and those of null component all stay; other
columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, mix, shingles, stored, take_worker, text_of, word_hashes
from .graph import components

POSITIONS = 60
CHUNKS = 12
SYMBOLS = POSITIONS // CHUNKS
DISTANCE = 2 * CHUNKS - 1
#: bits of the parity of a set, in longs
PARITY = 1024
#: star rounds go on while the pairs left to compare are more than this many per class
PAIRS_PER_CLASS = 2
MAX_STARS = 8

_rng = np.random.default_rng(20240229)
_MASK = _rng.integers(0, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 2**63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int):
    for words in word_hashes(texts, lower=True):
        yield np.unique(shingles(words, size))


#: bits of a symbol; the SYMBOLS symbols of a chunk lie in one long
BITS = 12
_LOW, _HIGH = (sum(x << (BITS * i) for i in range(SYMBOLS)) for x in ((1 << BITS - 1) - 1, 1 << BITS - 1))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One long of BITS-bit MinHash symbols for each chunk of a set."""
    low = np.full(POSITIONS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        part = (hashes[at:at + 1024, None] ^ _MASK) * _FACTOR
        np.minimum(low, part.min(axis=0), out=low)
    symbols = (mix(low) & np.uint64((1 << BITS) - 1)).reshape(CHUNKS, SYMBOLS)
    return (symbols << (np.uint64(BITS) * np.arange(SYMBOLS, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each bucket whether it has an odd number of the hashes."""
    odd = np.bincount((hashes & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def chunk_keys(s: Column) -> Column:
    """One key for each chunk and each position of it that is left out, with its number (see first_shared)."""
    whole = (1 << BITS * SYMBOLS) - 1
    keys = [(16 * chunk + skip, s[chunk].bitwiseAND(F.lit(whole ^ ((1 << BITS) - 1 << BITS * skip)))) for chunk in range(CHUNKS) for skip in range(SYMBOLS)]
    return F.array(*(F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), x).alias("key")) for t, x in keys))


def differing(a: Column, b: Column) -> Column:
    """How many symbols of two longs differ: the top bit of a symbol's lane is set if any of its bits is."""
    x = a.bitwiseXOR(b)
    return F.bit_count(((x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x)).bitwiseAND(F.lit(_HIGH)))


def distance(a, b) -> Column:
    return reduce(Column.__add__, (differing(a[i], b[i]) for i in range(CHUNKS)))


def few_differ(a, b, n: Column, percent: int) -> Column:
    """Whether the parities allow a link of sets of n shingles together: U - I of their U + I = n differ, 100 I >= percent U."""
    bits = reduce(Column.__add__, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY // 64)))
    return (100 + percent) * bits <= (100 - percent) * n


def first_shared(a, b, t: Column) -> Column:
    """Whether the shared key number t (16 chunk + position) is the first one that two signatures share: of a chunk without error it
    is the first key, of one with an error the only one they share, and no chunk before it has less than two errors.  So for every
    chunk t < 16 chunk + 16 ** errors; in this form the test is short enough for the JVM to compile the join that holds it."""
    return reduce(Column.__and__, (t < F.lit(16 * i) + F.call_function("shiftleft", F.lit(1), F.shiftleft(differing(a[i], b[i]), 2)) for i in range(CHUNKS)))


def _signing(size: int):
    @F.arrow_udf("struct<n:bigint,c:binary,s:array<bigint>,p:array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        take_worker("neardup")
        n, c, s, p = [], [], [], []
        for hashes in shingle_sets(as_bytes(texts), size):
            n.append(len(hashes))
            c.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            s.append(signature(hashes) if len(hashes) else None)
            p.append(parity(hashes) if len(hashes) else None)
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(s, longs), pa.array(p, longs)], names=["n", "c", "s", "p"])
    return sign


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(t) for t in as_bytes(texts)], pa.binary())


def _linking(size: int, percent: int):
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        take_worker("neardup")
        out, unpack = [], zstandard.ZstdDecompressor().decompress
        one, two = ([unpack(t) for t in x.to_pylist()] for x in (a, b))
        for sets in zip(shingle_sets(one, size), shingle_sets(two, size)):
            both = len(np.intersect1d(*sets, assume_unique=True))
            out.append(100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
        return pa.array(out, pa.bool_())
    return linked


def near_duplicates(docs: DataFrame, text: str = "text", id_: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root), one row per row of docs: component_id is the smallest
    id of the rows that chains of links (Jaccard of the shingle sets of at least percent / 100) reach.  text_hash
    (xxhash64 of the text, null as empty) tells rows of the same id apart, root (null without words) components of
    the same component_id."""
    rows = docs.select(F.col(id_).cast("bigint").alias("doc_id"), text_of(text).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("text_hash"), "t")
    signed = stored(rows.select("doc_id", "text_hash", _signing(size)("t").alias("x")).select("doc_id", "text_hash", "x.*"))
    classes = stored(signed.where("c IS NOT NULL").groupBy("c").agg(F.first("s").alias("s"), F.first("p").alias("p"), F.first("n").alias("n"),
                                                                     F.min(F.struct("doc_id", "text_hash")).alias("at")))
    keys = classes.select("c", "n", F.explode(chunk_keys(F.col("s"))).alias("k")).select("c", "n", "k.t", "k.key")
    shared = keys.groupBy("key").count().where("count > 1").select("key")
    members = stored(keys.join(shared, "key"))  # only keys that documents share

    # the texts of the documents that share a key, looked up once and kept compressed
    wanted = members.select("c").distinct().join(classes, "c").select("c", F.col("at.doc_id").alias("d"), F.col("at.text_hash").alias("h"))
    texts = stored(rows.join(wanted, (rows.text_hash == wanted.h) & rows.doc_id.eqNullSafe(wanted.d)).select("c", _packed("t").alias("t")).dropDuplicates(["c"]))

    # columns, not arrays: generated code of over 8,000 bytes, as bounds checks of the elements make it, is not compiled by the JVM
    part = lambda k, i: F.coalesce(F.get(k, F.lit(i)), F.lit(0).cast("long")).alias(f"{k}{i}")
    small = classes.select("c", *(part("s", i) for i in range(CHUNKS)), *(part("p", i) for i in range(PARITY // 64)), "n")
    sides = lambda k, n: ([F.col(f"{k}{i}{x}") for i in range(n)] for x in "ab")
    (sa, sb), (pa, pb) = sides("s", CHUNKS), sides("p", PARITY // 64)
    n_classes = classes.count()
    roots, links, tested, before = None, None, None, None

    def placed():
        """members with the root of their component."""
        if roots is None:
            return members.withColumn("root", F.col("c"))
        return members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    similar = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # sizes, signatures and parities of two classes may link
    likely = similar(F.col("na"), F.col("nb")) & (distance(sa, sb) <= DISTANCE) & few_differ(pa, pb, F.col("na") + F.col("nb"), percent)

    def near(pairs):
        """Those of the pairs (a, b) that may link."""
        one, two = (small.select(F.col("c").alias(x), *(F.col(k).alias(f"{k}{x}") for k in small.columns[1:])) for x in "ab")
        return pairs.join(one, "a").join(two, "b").where(likely).select("a", "b")

    def confirmed(pairs):
        """Those of the pairs (a, b) that are links."""
        both = pairs.join(texts.select(F.col("c").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("c").alias("b"), F.col("t").alias("tb")), "b")
        return stored(both.where(_linking(size, percent)("ta", "tb")).select("a", "b"))

    for turn in range(MAX_STARS + 1):
        at = stored(placed())
        # how many pairs of different components share a key
        by_root = at.groupBy("key", "root").agg(F.count("*").cast("double").alias("m"))
        left = by_root.groupBy("key").agg((F.sum("m") ** 2 - F.sum(F.col("m") ** 2)).alias("p")).agg(F.sum("p") / 2).first()[0] or 0
        if not left:
            break
        # a round that leaves most of the pairs shows that they are no links: hubs do not help any more
        last = left <= PAIRS_PER_CLASS * n_classes or turn == MAX_STARS or (before is not None and left > 0.8 * before)
        before = left
        mixed = at.join(by_root.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "key")
        if last:
            with_signs = mixed.drop("n").join(small, "c")
            x, y = (with_signs.select("key", "t", *(F.col(k).alias(f"{k}{c}") for k in ("root", *small.columns))) for c in "ab")
            x = x.drop("t")
            pair = F.expr("ca < cb AND roota <> rootb") & likely & first_shared(sa, sb, F.col("t"))
            pairs = x.join(y, (x.key == y.key) & pair).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs)
            found = confirmed(pairs)
        else:
            hubs = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("c", F.lit(turn)).alias("x"), "c", "n", "root")).alias("hub"))
            pairs = mixed.join(hubs, "key").where(similar(F.col("n"), F.col("hub.n")) & F.expr("root <> hub.root")).select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b")).distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs)
            found = confirmed(stored(near(pairs)))
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        roots = components(links)
        if last:
            break

    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node binary, root binary")
    of_class = classes.select("c").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("root"))
    ids = signed.where("c IS NOT NULL AND doc_id IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("d")).join(of_class, "c")
    smallest = ids.groupBy("root").agg(F.min("d").alias("component_id"))
    of_class = of_class.join(smallest, "root", "left").select("c", "root", "component_id")
    out = signed.join(of_class, "c", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def keep_one(docs: DataFrame, text: str = "text", id_: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of every component: the one with its id (of different texts that repeat this id within
    the component, the one with the lowest text hash; of rows that repeat id and text, the one whose other columns
    hash lowest).  Documents without words and without a component stay."""
    found = near_duplicates(docs, text, id_, size, percent).where("n_shingles > 0")
    # components of unrelated texts can have the same id, or none: their roots tell them apart
    nodes = found.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("at.*").alias("kept")
    alone = found.where("component_id IS NULL").select("text_hash").distinct()
    at, key = docs.alias("docs"), F.col(f"docs.`{id_}`").cast("bigint")
    content = F.coalesce(F.col(f"docs.`{text}`").cast("string"), F.lit(""))
    words, hash_ = content.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(content)
    # rows that repeat id and text meet as one row of each task; they differ in their other columns at most
    others = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"docs.`{c}`") for c in docs.columns if c not in (id_, text))))
    rows = at.where(words & key.isNotNull()).groupBy(key.alias("k"), hash_.alias("h")).agg(F.min_by(F.struct("docs.*"), F.xxhash64(others)).alias("row"))
    one = rows.join(nodes, (F.col("k") == F.col("kept.doc_id")) & (F.col("h") == F.col("kept.text_hash")), "left_semi").select("row.*")
    nameless = at.where(words & key.isNull()).join(alone.alias("alone"), hash_ == F.col("alone.text_hash"), "left_semi")
    return one.union(nameless).union(at.where(~words))

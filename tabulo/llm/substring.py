"""Substring dedup (operator 8): De Bruijn compaction over repeated word windows.

Every run of WINDOW words is an edge of the De Bruijn graph; an edge is repeated if its words start in a
second place.  Edges are not shuffled one by one.  Consecutive windows with the same minimizer (the least
hash of their SEED-word runs) form a path of the graph, and equal windows have equal minimizers, so:

1. a path sends its minimizer; minimizers that occur once are dropped (counts are pre-aggregated);
2. of the other paths, the hash of all words is sent.  Paths of equal words are repeated as a whole.  A path
   that is always followed by the same path, which always follows it, is not a branch: such paths are
   compacted, by joins over the distinct paths;
3. paths with a word sequence of their own that share the minimizer with others are opened: the 128-bit
   hashes of their windows are counted;
4. the source coordinates of the repeated paths and windows go back to their documents, are checked against
   the length of the text, merged to spans, and the words below them are removed.

The documents' texts are dealt out once, compressed, by their key (id and text hash); the plan reuses that exchange.

Edge cases: null and empty texts have no words; documents of fewer than WINDOW words lose nothing;
repeated rows count as separate places, so both lose their windows; null ids are allowed; a minimizer, path or
window that a third of the documents share is pre-aggregated or split by the skew join; other columns are
kept, n_words, n_removed and the text column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, mix, shingles, text_of, word_hashes

WINDOW = 35
SEED = 10
NO_ID = -(2**63)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        rest = width - have
        x = np.minimum(x[:len(x) - rest], x[rest:])
    return x


def paths(words: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first and last window start of each path.  A path ends where the minimizer's leftmost place
    in the window changes, so no two windows of a path are equal."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seeds = shingles(words, seed)
    least = _least_in_windows(seeds, window - seed + 1)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (seeds[:len(least) - 1] == least[:-1])]))
    return least[first], first, np.append(first[1:], len(least)) - 1


class Spans:
    """128-bit hashes of word spans, from running polynomial sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        self.sums, self.scales = [], []
        n = len(words)
        for base in _BASES:
            powers, scales = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
            np.cumprod(np.full(n, np.uint64(base)), out=powers[1:])
            np.cumprod(np.full(n, np.uint64(pow(base, -1, 2**64))), out=scales[1:])
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + np.uint64(base)) * powers[:-1])]))
            self.scales.append(scales)

    def of(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Scaled to start at power 0, so equal words have equal hashes wherever they stand."""
        size = mix((end - first).astype(np.uint64))
        return [mix((s[end] - s[first]) * k[first] ^ size).view(np.int64) for s, k in zip(self.sums, self.scales)]


def _lists(lengths: list[int], **fields: list[np.ndarray]) -> pa.Array:
    """Arrow lists of structs from the arrays of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    whole = {k: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for k, v in fields.items()}
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(whole.values()), names=list(whole)))


@F.arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(t) for t in as_bytes(texts)], pa.binary())


def _unpacked(texts: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in texts.to_pylist()]


#: a path's place: first window start and, in the lowest five bits, how many windows follow (under 32: it
#: shares one seed)
def _place(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 5 | (last - first)


@F.arrow_udf(T.ArrayType(T.StructType().add("m", T.LongType()).add("p", T.LongType())))
def _minimizers(texts: pa.Array) -> pa.Array:
    found = [paths(words) for words in word_hashes(as_bytes(texts))]
    return _lists([len(m) for m, _, _ in found], m=[m.view(np.int64) for m, _, _ in found], p=[_place(a, e) for _, a, e in found])


_DESCRIBED = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("m", "c", "p", "before", "after")]))


@F.arrow_udf(_DESCRIBED)
def _described(texts: pa.Array, chosen: pa.Array) -> pa.Array:
    """Of the chosen paths: minimizer, hash of all words, place, and the hash of the neighbouring paths, or 0
    where these were not chosen.  Places that are none of the text's paths are left out."""
    out = {k: [] for k in _DESCRIBED.elementType.names}
    sizes = []
    for words, rows in zip(word_hashes(_unpacked(texts)), chosen):
        m, a, e = paths(words)
        here = np.isin(_place(a, e), rows.values.to_numpy())
        m, a, e = m[here].view(np.int64), a[here], e[here]
        c = Spans(words).of(a, e + WINDOW)[0]
        next_to = a[1:] == e[:-1] + 1
        none = np.zeros(min(1, len(m)), np.int64)
        sizes.append(len(m))
        for k, v in zip(out, (m, c, _place(a, e), np.append(none, np.where(next_to, c[:-1], 0)), np.append(np.where(next_to, c[1:], 0), none))):
            out[k].append(v)
    return _lists(sizes, **out)


_WINDOWS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v", "s")]))


@F.arrow_udf(_WINDOWS)
def _windows(texts: pa.Array, opened: pa.Array) -> pa.Array:
    """128-bit hash of every window of the opened paths; s: start, and in the lowest bit whether its path is repeated."""
    us, vs, ss, sizes = [], [], [], []
    for words, rows in zip(word_hashes(_unpacked(texts)), opened):
        p, twice = rows.values.field(0).to_numpy(), rows.values.field(1).to_numpy()
        a, n = p >> 5, (p & 31) + 1
        start = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        start, twice = start[start + WINDOW <= len(words)], np.repeat(twice, n)[start + WINDOW <= len(words)]
        u, v = Spans(words).of(start, start + WINDOW)
        us.append(u), vs.append(v), ss.append(start << 1 | twice), sizes.append(len(u))
    return _lists(sizes, u=us, v=vs, s=ss)


@F.arrow_udf(T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept", T.StringType()))
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    n, gone, kept = [], [], []
    for t, rows in zip(_unpacked(texts), spans):
        words = t.split()
        n.append(len(words))
        if rows.is_valid and len(rows.values):
            a, e = (rows.values.field(i).to_numpy() for i in (0, 1))
            a, e = a[e + WINDOW <= len(words)], e[e + WINDOW <= len(words)]
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, a, 1)
            np.add.at(steps, e + WINDOW, -1)
            stay = np.cumsum(steps[:-1]) == 0
            words = [w for w, x in zip(words, stay.tolist()) if x]
        gone.append(n[-1] - len(words))
        kept.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])


KEY = ["k", "h"]


def repeated_spans(texts: DataFrame, packed: DataFrame) -> DataFrame:
    """texts (k, h, t), and packed (k, h, z) with the same texts compressed -> (k, h, a, e): first and last start
    of the windows of each repeated stretch."""
    sent = texts.select(*KEY, F.explode(_minimizers("t")).alias("x")).select("x.m", *KEY, "x.p")
    shared = sent.groupBy("m").count().where("count > 1").select("m")
    chosen = sent.join(shared, "m", "left_semi").groupBy(*KEY).agg(F.collect_set("p").alias("chosen"))  # a place once, however often its row is repeated
    path = chosen.join(packed, KEY).select(*KEY, F.explode(_described("z", "chosen")).alias("x")).select(*KEY, "x.*").where("m IS NOT NULL AND c IS NOT NULL")

    # distinct paths; a path's only follower or forerunner, if it has but one
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c))
    distinct = path.groupBy("m", "c").agg(F.count("*").alias("n"), only("before").alias("before"), only("after").alias("after"), F.min(F.struct(*KEY, "p")).alias("at"))
    # one array, which cannot be pruned (and no nulls, which each join would filter in its own way): all uses below need the same
    # rows and columns and share one exchange, so the texts are described once for all of them and not once for each
    fields = "n", "before", "after", "at.k", "at.h", "at.p"
    distinct = distinct.select("m", "c", F.flatten(F.array(F.array(*fields))).alias("all"))
    distinct = distinct.select("m", "c", *(F.col("all")[i].alias(c.split(".")[-1]) for i, c in enumerate(fields)))

    # compaction: a repeated path that always follows the same path, which it alone follows, continues that path
    whole = distinct.where("n > 1").select("m", "c", "before", "after")
    forerunner = whole.where("after IS NOT NULL").select(F.col("c").alias("before"), F.col("after").alias("c")).distinct()
    whole = whole.join(forerunner.withColumn("goes_on", F.lit(1)), ["before", "c"], "left").select("m", "c", F.coalesce("goes_on", F.lit(0)).alias("goes_on"))
    stretch = Window.partitionBy(*KEY).orderBy("p")
    placed = path.select(*KEY, "m", "c", "p").join(whole, ["m", "c"])
    placed = placed.withColumn("stretch", F.sum(1 - F.col("goes_on")).over(stretch))
    first = F.shiftright("p", 5)
    last = first + F.col("p").bitwiseAND(F.lit(31))
    compacted = placed.groupBy(*KEY, "stretch").agg(F.min(first).alias("a"), F.max(last).alias("e")).drop("stretch")

    # paths of their own: their windows against those of all paths with the same minimizer
    mixed = distinct.groupBy("m").agg(F.min("n").alias("fewest")).where("fewest = 1").select("m")
    opened = distinct.join(mixed, "m", "left_semi").select(*KEY, "p", (F.col("n") > 1).cast("bigint").alias("twice"))
    opened = opened.groupBy(*KEY).agg(F.collect_list(F.struct("p", "twice")).alias("opened"))
    window = opened.join(packed, KEY).select(*KEY, F.explode(_windows("z", "opened")).alias("x")).select("x.u", "x.v", *KEY, "x.s")
    again = window.groupBy("u", "v").agg(F.sum(1 + F.col("s").bitwiseAND(F.lit(1))).alias("n")).where("n > 1").select("u", "v")
    single = window.join(again, ["u", "v"], "left_semi").select(*KEY, F.shiftright("s", 1).alias("a"), F.shiftright("s", 1).alias("e"))
    return compacted.unionByName(single)


def remove_repeated(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """docs with the words of repeated windows removed from the text (the kept words joined by one space), and
    n_words (before) and n_removed."""
    k, h = fresh(docs, "_k"), fresh(docs, "_h")
    # the id's column comes back from its key, so that only key and text are dealt out
    texts = docs.select(F.coalesce(F.col(id_).cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("t"))
    packed = texts.select("k", "h", _packed("t").alias("z"))
    spans = repeated_spans(texts, packed).groupBy(*KEY).agg(F.collect_set(F.struct("a", "e")).alias("spans"))
    done = packed.join(spans, KEY, "left").withColumn("r", _without("z", "spans")).select(*KEY, "r.*")
    others = [c for c in docs.columns if c not in (id_, text, "n_words", "n_removed")]
    out = done.withColumnsRenamed({"k": k, "h": h, "kept": text}).withColumn(id_, F.nullif(F.col(k), F.lit(NO_ID)).cast(docs.schema[id_].dataType))
    if others:
        keyed = docs.select(F.coalesce(F.col(id_).cast("bigint"), F.lit(NO_ID)).alias(k), F.xxhash64(text_of(text)).alias(h), *(F.col(f"`{c}`") for c in others))
        out = out.dropDuplicates([k, h]).join(keyed, [k, h])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed")), "n_words", "n_removed")

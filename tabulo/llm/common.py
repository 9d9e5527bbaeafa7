"""Helpers shared by the training-data operators: session settings, column
lookup, worker-side word hashing, tables stored in the shared folder."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, ensure_checkpoint_dir

#: white space that separates words: space and \x09-\x0D
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: rows of one Arrow batch; texts can be long, so fewer than Spark's default
ARROW_ROWS = "1000"
#: whether Spark removes an execution's shuffle files at its end
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of df (case-insensitive)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs of one block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder of ``spark.checkpoint.dir`` and read back.  The
    files outlive lost executors and, unlike an RDD checkpoint, are compressed and read by column.
    The shuffle files of the write, which nothing reads again, go with its end."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_worker: list = []  # the operator that had this Python worker last, and what frees its tables


def take_worker(operator: str, *free) -> None:
    """Spark hands a Python worker on to the next stage with all that its modules hold.  A function that runs in workers calls
    this first, so that the tables another operator kept from task to task are freed; those of the same operator stay."""
    if _worker and _worker[0] != operator:
        for f in _worker[1]:
            f()
    _worker[:] = [operator, free]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: bytes that are hashed at once; longer texts are cut at white space
CHUNK = 1 << 20
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(CHUNK + 1, np.uint64)
np.cumprod(np.full(CHUNK, np.uint64(_BASE)), out=_POWERS[1:])
_SCALES = np.ones(CHUNK + 1, np.uint64)
np.cumprod(np.full(CHUNK, np.uint64(pow(_BASE, -1, 2**64))), out=_SCALES[1:])


def _hashed(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of at most CHUNK bytes: a polynomial of the bytes' random numbers, scaled
    to begin at power 0, from running sums."""
    b = np.frombuffer(data, np.uint8)
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(table[b] * _POWERS[:len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * _SCALES[start] ^ (end - start).astype(np.uint64)), start


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _long(data: bytes, table: np.ndarray, lower: bool):
    """Hashes of the words of a text of over CHUNK bytes, part by part; the parts end at white space."""
    at = 0
    while at < len(data):
        cut = max(data.rfind(blank, at, at + CHUNK) for blank in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0 and len(data) - at > CHUNK:  # a word longer than that
            end = found.start() if (found := _BLANK.search(data, at)) else len(data)
            word = data[at:end].lower() if lower else data[at:end]
            yield np.array([xxhash.xxh64_intdigest(word)], np.uint64)
            at = end
        else:
            end = cut + 1 if len(data) - at > CHUNK else len(data)
            yield _hashed(data[at:end], table)[0]
            at = end


def word_hashes(texts: list[bytes], lower: bool = False):
    """For each text the 64-bit hashes of its words, in order; lower: A-Z count as a-z."""
    table = _BYTE_LOWER if lower else _BYTE
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + 1 + len(texts[end]) <= CHUNK:
            size += 1 + len(texts[end])
            end += 1
        if size > CHUNK:
            yield np.concatenate(list(_long(texts[at], table, lower)))
        else:
            hashes, start = _hashed(b"\n".join(texts[at:end]), table)
            ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
            cuts = np.concatenate([[0], np.searchsorted(start, ends)])
            for i in range(end - at):
                yield hashes[cuts[i]:cuts[i + 1]]
        at = end


def as_bytes(texts) -> list[bytes]:
    """An Arrow column of strings as UTF-8."""
    return texts.cast(pa.binary()).to_pylist()


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; fewer words count as one run, none give none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
        out ^= out >> np.uint64(29)
    return mix(out)

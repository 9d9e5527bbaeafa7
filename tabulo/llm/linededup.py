"""Line dedup (operator 2): exact set-similarity join of lines, DataFrame functions only.

A line is the set of its lower-cased words.  A line goes if an earlier one (by document id, then text hash,
then place) is equal or has a Jaccard similarity of at least 0.8.

1. Lines of equal lower-cased text are one class; its first line stands for it (pre-aggregated, so a line
   that a third of the documents share is one row per task).  Classes are numbered in the order of their first lines.
2. The words of each class are read once from the first line's document and stored as hashes; all later steps use them.
3. They are ordered by rarity, hash next: the classes that have a word, counted in BUCKETS hash buckets, are the
   fixed-size table every task gets.  Any order gives the same result, rarity makes it cheap.
4. Prefix filter: classes are joined on the n - ceil(0.8 n) + 1 rarest of their n words (of the shorter line,
   n - ceil(8/9 n) + 1 are enough); length filter and positional filter (the words from the first common one
   on must suffice) are part of the join, and so is a 64-bit parity of the words, which bounds how many differ;
   512 bits of them are compared for the pairs that are left.
5. The candidates' Jaccard similarity is computed on their whole word sets: for each later line first with its
   earliest candidate, then, unless it goes by that, with all others.
6. A document keeps the lines that are first in a class that stays, and those without words.

Words are 64-bit hashes, 56 bits of them in the join (a wrong result needs two words of a pair of lines to collide,
under 1e-12 for 1,000 words); classes are 128-bit hashes.

Edge cases: lines without words never match and stay; null and empty texts are unchanged; rows that repeat
id and text are one document and get the same result; null ids come first; other columns are kept as they are; a
document all of whose lines go keeps its row with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

BUCKETS = 1 << 16
NO_ID = -(2**63)
#: parities of 64 bits a candidate
MARKS = 8
#: words recur within a file, so that a dictionary larger than Spark's 1 MB halves the stored hashes
DICTIONARY = {"parquet.dictionary.page.size": str(16 << 20)}
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
KEY = ["k", "h"]


def words_of(lower: Column) -> Column:
    """Hashes of the distinct words of a lower-cased line, split at ASCII white space."""
    # a single blank splits without a regular expression
    words = F.when(lower.rlike("[\\x09-\\x0D]"), F.split(lower, BLANKS, -1)).otherwise(F.split(lower, " ", -1))
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(words: DataFrame) -> Column:
    """word hash -> 0..127, by how many classes have words of its bucket; the table is a literal array of BUCKETS bytes."""
    counted = words.select(F.explode("s").alias("w")).groupBy(_bucket(F.col("w")).alias("b"))
    table = [0] * BUCKETS
    for r in counted.agg(F.least(F.lit(127), F.floor(4 * F.log2(F.count("*") + 1))).cast("int").alias("c")).collect():
        table[r.b] = r.c
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")


def _lines(texts: DataFrame) -> DataFrame:
    """Every line with words: its document, place and text hash (x, y)."""
    lines = texts.select(*KEY, F.posexplode(F.split("t", "\n", -1)).alias("i", "line")).where(F.col("line").rlike(WORD))
    lower = F.lower("line")
    return lines.select(*KEY, "i", F.xxhash64(lower).alias("x"), F.xxhash64(lower, F.lit(1)).alias("y"))


def _once(texts: DataFrame) -> DataFrame:
    """Repeated rows once; all joins with the texts share this exchange."""
    return texts.groupBy(*KEY).agg(F.first("t").alias("t"))


def _words(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The number r of each class and its words s, of its first line, looked up in its document."""
    asked = classes.select("first.*", "r").groupBy(*KEY).agg(F.collect_list(F.struct("i", "r")).alias("asked"))
    split = _once(texts).select(*KEY, F.split("t", "\n", -1).alias("all"))  # below the join, so once a text
    line = lambda q: F.struct(q.r.alias("r"), F.lower(F.col("all")[q.i]).alias("line"))
    found = asked.join(split, KEY).select(F.explode_outer(F.transform("asked", line)).alias("q"))
    return found.select("q.r", words_of(F.col("q.line")).alias("s"))


def _bit(word: Column) -> Column:
    """The one of 64 bits that six bits of the word's hash name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), word.bitwiseAND(F.lit(63)).cast("int"))


def _marks(words: DataFrame) -> DataFrame:
    """For each r the number of words and MARKS parities: a word flips one bit of one of them."""
    w = F.shiftrightunsigned("w", 20)  # other bits than in the postings
    slot = F.shiftrightunsigned("w", 40).bitwiseAND(F.lit(MARKS - 1))
    parities = (F.bit_xor(F.when(slot == j, _bit(w)).otherwise(F.lit(0).cast("long"))).alias(f"b{j}") for j in range(MARKS))
    return words.select("r", F.explode("s").alias("w")).groupBy("r").agg(F.count("*").alias("n"), *parities)


def _postings(words: DataFrame) -> DataFrame:
    """One row for each word w of the prefix of a class: p (place of the word), r, n (words), bits (every word flips one)."""
    table = _rarity(words)
    # coalesce: an array without nulls is sorted as plain longs
    key = lambda x: F.coalesce(F.shiftleft(table[_bucket(x)].cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8)), F.lit(0).cast("long"))
    lines = words.select("r", F.size("s").alias("n"), F.sort_array(F.transform("s", key)).alias("s"))
    needed = F.col("n") - F.ceil(F.col("n") * 4 / F.lit(5)).cast("int") + 1
    bits = F.aggregate("s", F.lit(0).cast("long"), lambda b, k: b.bitwiseXOR(_bit(k)))
    # a select of its own: beside posexplode, the bits would be computed for every posting; _outer: no filter on the
    # prefix, which would compute it once more (every line has a word)
    lines = lines.select("r", "n", bits.alias("bits"), F.slice("s", F.lit(1), needed).alias("prefix"))
    return lines.select("r", "n", "bits", F.posexplode_outer("prefix").alias("p", "w")).where("p IS NOT NULL AND w IS NOT NULL")


def similar_lines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (k, h, t) -> classes (r, first), later (r): the classes that an earlier class is similar to."""
    first = _lines(texts).groupBy("x", "y").agg(F.min(F.struct(*KEY, "i")).alias("first"))
    # the numbers rise with the order of the rows, of which each is the first line of one class
    classes = stored(first.orderBy("first").select(F.monotonically_increasing_id().alias("r"), "first"))
    words = stored(_words(texts, classes), **DICTIONARY)
    posted = _postings(words)
    a = posted.select("w", *(F.col(c).alias(f"{c}1") for c in ("r", "n", "p", "bits")))
    b = posted.select("w", *(F.col(c).alias(f"{c}2") for c in ("r", "n", "p", "bits")))
    n1, n2, p1, p2, r1, r2 = (F.col(c) for c in ("n1", "n2", "p1", "p2", "r1", "r2"))
    length = (5 * n1 >= 4 * n2) & ((n1 < n2) | ((n1 == n2) & (r1 < r2)))
    # of the shorter line, 8/9 of the words are common, so one of the n1 - 8/9 n1 + 1 rarest (n1 is the least; a filter of
    # one side alone would go below the exchange that both sides share)
    shorter = 9 * (n1 - p1) >= 8 * F.least(n1, n2)
    position = 9 * F.least(n1 - p1, n2 - p2) >= 4 * (n1 + n2)
    # words of one line only flip at least as many bits as differ; a match has (n1 + n2) / 9 of them at most
    few = 9 * F.bit_count(F.col("bits1").bitwiseXOR(F.col("bits2"))) <= n1 + n2
    pairs = a.join(b, (a.w == b.w) & length & shorter & position & few)
    pairs = stored(pairs.select(F.greatest(r1, r2).alias("l"), F.least(r1, r2).alias("e")).distinct())

    # the candidates' words, dealt out once; the one parity says little of lines with many words, so pairs are first
    # compared by several
    wanted = pairs.select(F.explode(F.array("l", "e")).alias("r")).distinct()
    read = stored(words.join(wanted, "r", "left_semi"), **DICTIONARY)
    marks = _marks(read)
    for c in "le":
        pairs = pairs.join(marks.select(*(F.col(x).alias(c if x == "r" else f"{x}{c}") for x in marks.columns)), c)
    differ = sum((F.bit_count(F.col(f"b{j}l").bitwiseXOR(F.col(f"b{j}e"))) for j in range(MARKS)), F.lit(0))
    pairs = stored(pairs.where(9 * differ <= F.col("nl") + F.col("ne")).select("l", "e"))
    one, two = (read.select(F.col("r").alias(c), F.col("s").alias(f"s{c}")) for c in "le")
    similar = 9 * F.size(F.array_intersect("sl", "se")) >= 4 * (F.size("sl") + F.size("se"))

    def confirmed(asked: DataFrame) -> DataFrame:
        return stored(asked.join(one, "l").join(two, "e").where(similar).select(F.col("l").alias("r")).distinct())

    # most later lines go by their earliest candidate; only those that stay are compared with the others
    earliest = pairs.groupBy("l").agg(F.min("e").alias("e"))
    gone = confirmed(earliest)
    left = pairs.join(gone.withColumnRenamed("r", "l"), "l", "left_anti").join(earliest, ["l", "e"], "left_anti")
    return classes, gone.union(confirmed(left))


def remove_similar_lines(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """docs with the later of equal or similar lines removed from the text, and n_lines (before) and n_removed."""
    hashed = F.coalesce(F.col(id_).cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.col(text).cast("string"))  # a null hashes unlike an empty text
    texts = docs.select(*(c.alias(n) for c, n in zip(hashed, KEY)), F.col(text).cast("string").alias("t"))
    classes, later = similar_lines(texts)
    kept = classes.join(later, "r", "left_anti").select("first.*").groupBy(*KEY).agg(F.collect_set("i").alias("kept"))
    k, h = fresh(docs, "_k"), fresh(docs, "_h")
    stays = lambda line, i: F.coalesce(F.array_contains("kept", i), F.lit(False)) | ~line.rlike(WORD)
    split = _once(texts).select(*KEY, F.split("t", "\n", -1).alias("all")).join(kept, KEY, "left")
    split = split.select(*KEY, F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n"), F.filter("all", stays).alias("all"))
    done = split.select(
        F.col("k").alias(k), F.col("h").alias(h), F.array_join("all", "\n").alias(text), F.col("n").alias("n_lines"),
        (F.col("n") - F.coalesce(F.size("all"), F.lit(0))).cast("long").alias("n_removed"))
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    keyed = docs.select(*(c.alias(n) for c, n in zip(hashed, (k, h))), *(F.col(f"`{c}`") for c in others))
    return done.join(keyed, [k, h]).select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")

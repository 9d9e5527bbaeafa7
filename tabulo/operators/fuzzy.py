"""Dictionary corrections (C10-C14): exact, fuzzy and reference categories.

All matching runs on the DISTINCT values of a column (one shuffle, map-side
combined), never per row, and only by equi-joins: neither the values nor the
dictionary pass the driver, and both may have any size.  The resulting
mapping (one row per distinct value that has a correction) is checkpointed,
its size checked, and joined back by broadcast when small -- otherwise by a
shuffle join, where AQE's skew handling splits a hot value.

Fuzzy score (deviation D5): ``100 * (1 - levenshtein / greatest(len))``,
accepted when > 80, so fewer than a fifth of the longer string's characters
may change.  A key is cut into one piece more than the changes it allows; by
the pigeonhole principle one piece occurs unchanged in every value that
matches, shifted by no more than the changes before and after it.  Values
emit the substrings that may be such a piece and meet the keys on (key
length, piece number, piece).

Containment (C12): every variant looks for its rarest n-gram (counted over
the distinct values) among the values' n-grams, then the whole variant is
verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import qcol, strip_ws

MAX_DICTIONARY_ROWS = 1_000_000  # rows of a mapping that is joined back by broadcast

# Canonical lists shipped as the default reference
# categories (C13), in the reference's order.
KNOWN_CATEGORIES = {
    "statut": ["Terminé", "Abandonné", "En cours", "Inscrit"],
    "financeur": ["CPF", "Région", "France Travail", "OPCO", "Auto-financé"],
    "niveau": ["Débutant", "Intermédiaire", "Avancé", "Expert"],
}

# Name fragments that make a category column strict (C14).
STRICT_WORDS = ["statut", "état", "etat", "status", "state", "financeur", "financier", "level", "niveau"]


def is_strict_column(name: str) -> bool:
    low = name.lower()
    return any(w in low for w in STRICT_WORDS)


def known_categories_df(spark) -> DataFrame:
    """C13 as a reference-category DataFrame (column, canonical, variant, ord);
    the variants of a canonical value are its lower-cased form."""
    rows, k = [], 0
    for col, values in KNOWN_CATEGORIES.items():
        for v in values:
            rows.append((col, v, v.lower(), k))
            k += 1
    return spark.createDataFrame(rows, "column string, canonical string, variant string, ord int")


GRAM = 3  # characters of an n-gram; shorter variants are looked up whole


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of `size` characters (none of a shorter text)."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def contained_matches(values: DataFrame, variants: DataFrame) -> DataFrame:
    """values(value_key) x variants(key, ...) -> the pairs where the value contains the key.  Empty keys match nothing."""
    v = variants.filter(F.length("key") > 0).withColumn("_size", F.least(F.lit(GRAM), F.length("key")))
    sizes = [r[0] for r in v.select("_size").distinct().collect()]  # at most GRAM numbers
    if not sizes:
        return values.join(variants.withColumn("value_key", F.col("key")).limit(0), "value_key")
    of_values = F.concat(*(_grams(F.col("value_key"), F.lit(n)) for n in sorted(sizes)))
    posted = values.select("value_key", F.explode(of_values).alias("_gram"))
    counts = posted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keys = v.select("key", "_size").distinct().select("key", F.explode(_grams(F.col("key"), F.col("_size"))).alias("_gram"))
    # a gram that no value has rules its key out: the left join keeps it, with a count of 0, as the rarest one
    rarest = keys.join(counts, "_gram", "left").groupBy("key").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("r"))
    rarest = rarest.filter("r.n > 0").select("key", F.col("r.gram").alias("_gram"))
    found = posted.join(rarest, "_gram").filter(F.contains(F.col("value_key"), F.col("key"))).select("value_key", "key")
    return found.join(variants, "key")


def _join_back(base: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the (value -> canonical) mapping: one row per distinct corrected
    value.  Broadcast when its size is checked small; otherwise a shuffle
    join (AQE splits a hot value's partition)."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(base.sparkSession)
    # materialised once (shared checkpoint folder): the size check and the join read the same rows
    mapping = mapping.withColumnRenamed("value_key", "__k").checkpoint(eager=True)
    if mapping.count() <= MAX_DICTIONARY_ROWS:
        mapping = F.broadcast(mapping)
    return base.join(mapping, "__k", "left")


def _changes(length: Column, share: float) -> Column:
    """Changes that a match between two strings may need, the longer one being as long as `length`: fewer than that share."""
    return F.ceil(length * share - 1e-9).cast("int") - 1


def piece_pairs(values: DataFrame, keys: DataFrame, threshold: float = 80.0) -> DataFrame:
    """(value_key, key) of all pairs that may score above the threshold: they share a piece of the key."""
    share = 1.0 - threshold / 100.0
    length = F.length("key")
    longest = F.ceil(length / (1 - share) - 1e-9).cast("int") - 1  # of the values that can match
    k = keys.select("key").distinct().select("key", length.alias("_len"), _changes(F.greatest(longest, length), share).alias("_k")).filter("_k >= 0")
    place = lambda s: F.floor(s * F.col("_len") / (F.col("_k") + 1)).cast("int")  # noqa: E731  where piece s begins
    pieces = k.select("key", "_len", "_k", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_s"))
    pieces = pieces.select("key", "_len", "_s", F.substring(F.col("key"), place(F.col("_s")) + 1, place(F.col("_s") + 1) - place(F.col("_s"))).alias("_piece"))

    lengths = k.select("_len", "_k").distinct()  # few numbers
    v = values.select("value_key", F.length("value_key").alias("_vlen"))
    of_length = v.select("_vlen").distinct().select("_vlen", F.explode(F.sequence(F.floor(F.col("_vlen") * (1 - share)).cast("int"), F.ceil(F.col("_vlen") / (1 - share)).cast("int"))).alias("_len"))
    of_length = of_length.join(lengths, "_len").filter(F.abs(F.col("_vlen") - F.col("_len")) <= _changes(F.greatest("_vlen", "_len"), share))
    # piece s may be shifted by the s changes before it, and by no more than the others after it
    probe = of_length.select("_vlen", "_len", "_k", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_s"))
    at, more, after = place(F.col("_s")), F.col("_vlen") - F.col("_len"), F.col("_k") - F.col("_s")
    size = place(F.col("_s") + 1) - at
    low = F.greatest(at - F.col("_s"), at + more - after, F.lit(0))
    high = F.least(at + F.col("_s"), at + more + after, F.col("_vlen") - size)
    probe = probe.select("_vlen", "_len", "_s", low.alias("_low"), high.alias("_high"), size.alias("_size")).filter("_low <= _high")
    cut = v.join(probe, "_vlen").select("value_key", "_len", "_s", "_size", F.explode(F.sequence("_low", "_high")).alias("_at"))
    cut = cut.select("value_key", "_len", "_s", F.substring(F.col("value_key"), F.col("_at") + 1, F.col("_size")).alias("_piece"))
    return cut.join(pieces, ["_len", "_s", "_piece"]).select("value_key", "key").distinct()


def fuzzy_candidates(values: DataFrame, keys: DataFrame, threshold: float = 80.0) -> DataFrame:
    """values(value_key string, distinct) x keys(key string, ord, canonical) ->
    (value_key, key, ord, canonical, score): the best key per value by (score desc, ord asc, key)
    with score > threshold."""
    pairs = piece_pairs(values, keys, threshold)
    longer = F.greatest(F.length("value_key"), F.length("key"))
    score = 100.0 * (1 - F.levenshtein("value_key", "key") / longer)
    scored = pairs.withColumn("score", score).filter(F.col("score") > threshold).join(keys, "key")
    best = scored.groupBy("value_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "key", "canonical")).alias("b"))
    return best.select("value_key", "b.key", "b.ord", "b.canonical", (-F.col("b.s")).alias("score"))


def correct_exact_fuzzy(df: DataFrame, col: str, dictionary: DataFrame, fuzzy: bool = True,
                        threshold: float = 80.0) -> DataFrame:
    """C10 + C11 for one column.  ``dictionary(column, variant, canonical[, ord])``:
    exact case-insensitive match on the trimmed value, else the best fuzzy key
    (score > threshold), else the trimmed original.  Empty tokens -> NULL."""
    d = dictionary.filter(F.col("column") == col)
    if "ord" not in d.columns:
        d = d.withColumn("ord", F.col("variant"))  # its order is all that matters
    d = d.select(F.lower("variant").alias("key"), "canonical", "ord")
    s = strip_ws(qcol(col).cast("string"))
    base = df.withColumn("__v", s).withColumn("__k", F.lower(F.col("__v")))
    vals = base.select(F.col("__k").alias("value_key")).filter(F.col("value_key").isNotNull()).distinct()
    exact = vals.join(d.withColumnRenamed("key", "value_key"), "value_key").groupBy("value_key").agg(
        F.min_by("canonical", "ord").alias("canon"))
    mapping = exact
    if fuzzy:
        unmatched = vals.join(exact, "value_key", "left_anti")
        fz = fuzzy_candidates(unmatched, d, threshold).select("value_key", F.col("canonical").alias("canon"))
        mapping = exact.unionByName(fz)
    out = _join_back(base, mapping)
    empty = F.col("__k").isin("", "nan", "null", "none", "?", "inconnu", "-", "--")
    return out.withColumn(col, F.when(F.col("__v").isNull() | empty, F.lit(None).cast("string"))
                          .otherwise(F.coalesce(F.col("canon"), F.col("__v")))).drop("__v", "__k", "canon")


def reference_categories(df: DataFrame, col: str, refs: DataFrame, strict: bool,
                         threshold: float = 80.0) -> DataFrame:
    """Variant equality or containment -> canonical (first in dictionary
    order), else fuzzy > threshold over all variants, else NULL (strict) or
    the trimmed value (lenient).  ``refs(column, canonical, variant, ord)``."""
    r = refs.filter(F.col("column") == col).select(F.lower("variant").alias("key"), "canonical",
                                                    F.col("ord").cast("int").alias("ord"))
    s = strip_ws(qcol(col).cast("string"))
    base = df.withColumn("__v", s).withColumn("__k", F.lower(F.col("__v")))
    vals = base.select(F.col("__k").alias("value_key")).filter(F.col("value_key").isNotNull()).distinct()
    # containment includes equality
    contained = contained_matches(vals, r).groupBy("value_key").agg(
        F.min_by("canonical", "ord").alias("canon"))
    rest = vals.join(contained, "value_key", "left_anti")
    fz = fuzzy_candidates(rest, r, threshold).select("value_key", F.col("canonical").alias("canon"))
    out = _join_back(base, contained.unionByName(fz))
    empty = F.col("__k").isin("", "nan", "null", "none", "?", "inconnu", "-", "--")
    fallback = F.lit(None).cast("string") if strict else F.col("__v")
    return out.withColumn(col, F.when(F.col("__v").isNull() | empty, F.lit(None).cast("string"))
                          .otherwise(F.coalesce(F.col("canon"), fallback))).drop("__v", "__k", "canon")

"""Corpus pipeline: five operators one after another over ``documents``.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents.
Edge cases are those of the operators; an empty table goes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulo.llm import bpe, decontaminate, langid, linededup, neardup
from tabulo.llm.common import prepare, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroids reject (operator 6)."""
    prepare(spark)
    return langid.keep_known(docs, langid.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of equal or similar lines go from the texts (operator 2); n_chars follows the text."""
    prepare(spark)
    done = linededup.remove_similar_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 7)."""
    prepare(spark)
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item (operator 1)."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text decoded from them (operator 3)."""
    prepare(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), *vocabulary)
    decoded = bpe.decode_documents(encoded, *vocabulary)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontaminate", without_benchmark),
    ("byte_bpe", tokens),
]
#: no SQL for learned centroids and transducers; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

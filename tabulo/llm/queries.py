"""Registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, fingerprint, langid, licenses, linededup, merkle, neardup, oracles, quality, secrets, substring, warc
from .common import stored, table, text_of

QUERIES: dict = {}
ORACLE: dict = {"op11_warc": oracles.OP11, "op12_merkle": oracles.OP12}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fold(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(column).cast("string")) % n


@query
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """(document, item) pairs; one row for repeated rows of a document."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return decontaminate.find_contaminated(docs, items)


@query
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = linededup.remove_similar_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(docs, *vocabulary)
    decoded = bpe.decode_documents(encoded, *vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


@query
def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf, "documents"))


@query
def op6_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = neardup.near_duplicates(docs, size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op8_substring(spark: SparkSession, sf: str) -> DataFrame:
    done = substring.remove_repeated(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    positive = labels.where(~held_out & (F.col("quality") == 1)).select("doc_id").distinct()
    model = quality.fit(positive, docs.where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(model, spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op10_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    found = fingerprint.fingerprint_edits(table(spark, sf, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


@query
def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.scratch(spark)
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.page_captures(warc.captures(stored(warc.read_archives(spark, folder, keep_payload=False))))


@query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    found = merkle.document_manifest(table(spark, sf, "documents"))
    found = found.withColumn("folded_root", merkle.fold(F.col("changed_leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_align(spark: SparkSession, sf: str) -> DataFrame:
    vocabularies = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align_corpus(table(spark, sf, "documents"), *vocabularies)

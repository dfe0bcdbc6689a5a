"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, licenses, merkle, minhash, mixing, quality, simhash, spelling, substring_dedup, warc
from . import toxicity as tox
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/language/hundred/id.txt, for want of a path column."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.expr("doc_id div 100").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.license_scan(files).withColumnRenamed("file_id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.neighbours(table(spark, sf_dir, "conversations")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts and languages the paths, for want of addresses."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later sentences of five words or more and later whole lines of any length; shorter fragments in runs of 30 words."""
    return substring_dedup.repeated_units(table(spark, sf_dir, "documents"), min_unit_words=5).drop("text_key")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), typo_every=199)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a checksum of doc_id, are received without their line ends."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_decontamination, op4_warc, op5_chat_formatting, op6_mixing, op7_exact_dedup, op8_quality, op9_simhash_dedup, op10_substring_dedup, op11_spelling_variants, op12_minhash_dedup, op13_merkle_manifest)}
ORACLES = {"op5_chat_formatting": chat.ORACLE, "op6_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_minhash_dedup": minhash.ORACLE, "op13_merkle_manifest": merkle.ORACLE}

"""The corpus pipeline: each stage is one of the operators, takes what the stage before kept, and is written and reread.

Every stage takes null and empty texts, null and repeated doc_ids, repeated rows and an empty table as its operator's
docstring says; all but the last keep the columns of `documents` as they are. The stages' own tables are deleted when the
stage has been written, and a stage's output when the next has been.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from tidemark.llm.common import remove, stored, table, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; null and empty texts are scored like others."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one row: the longest original, then the smallest doc_id, null last; null texts are empty ones."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies by SimHash one row, that of the smallest doc_id, null last; texts without words are one component."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and items without words aren't looked for."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, 0 included; the texts are those of the stage before. A row a document, null sources last."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: SimHash, the label model and BM25 have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            kept = stage(spark, docs, sf_dir)
            path = stored(kept, name.replace(" ", "-"))
        docs = spark.read.schema(kept.schema).parquet(path)
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

"""Listings of files: path, size and time of change as Spark's file source knows them, with the first bytes if wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, pattern: str | None = None, modified_before: str | None = None, head: int = 0) -> DataFrame:
    """path, size, modified and, with `head`, the file's first so many bytes of all files below `path`, whose name fits `pattern`, changed before a time.

    Without `head` no file is opened.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for name, told in (("pathGlobFilter", pattern), ("modifiedBefore", modified_before)):
        if told:
            r = r.option(name, told)
    first = [F.substring("content", 1, head).alias("head")] if head else []
    return r.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"), *first)


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """The files of a listing that an earlier one doesn't have with the same size and time of change: new ones and changed ones."""
    same = ["path", "size", "modified"]
    return now.join(known.select(*same), same, "left_anti")


def removed(now: DataFrame, known: DataFrame) -> DataFrame:
    """The files of an earlier listing that are gone."""
    return known.join(now.select("path"), "path", "left_anti")

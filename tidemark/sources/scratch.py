"""Scratch folders that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only a local session may name none, as executors elsewhere wouldn't share it."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(told)
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lines(df: DataFrame, name: str) -> str:
    """The folder of a text file written from a one-column table."""
    path = folder(df.sparkSession, name)
    df.write.text(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder: what is read several times isn't computed as often, and a lost executor costs no more than its tasks."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

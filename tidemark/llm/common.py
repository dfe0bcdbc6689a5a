"""Helpers that the training-data operators share: shared scratch tables, skew-safe lookups, table access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Lists of the tables that `materialise` has written since a `temporary` block began, innermost last.
_open: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where the session names none, a local one is made if driver and executors are one process, else the call fails:
    executors would write elsewhere.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """The path of a new table in the shared folder."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs no recomputation."""
    path = stored(df, name)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder in the shared one for files that tasks write themselves, as a URI."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    uri = path if re.match(r"[a-z][a-z0-9+.-]*:/", path) else f"file://{path}"
    fs, at = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", uri) else uri)
    fs.create_dir(at, recursive=True)
    return uri


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of the scratch folder that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that `materialise` writes inside: what is to stay is written outside, or is read before."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, _open.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    """`docs` as one struct column `doc`, so that no column of theirs can clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def unpacked(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col("doc").getField(c).alias(c) for c in names])


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """again: the values of doc_id that several rows have, null among them; None if there are none. Only doc_id is read."""
    ids = docs.select(F.col("doc_id").cast("long").alias("again")).groupBy("again").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    found = materialise(ids, "repeated")
    return None if found.isEmpty() else found


def least_hashes(ids: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """`most` rows of `ids` at most, those of the least hashes: a bounded sample that reruns repeat.

    Rows whose hash is above twice the share that is wanted are left out before the order, so that the one task that
    orders gets about twice `most` rows, whatever the input.
    """
    n = ids.count()
    u = F.pmod(F.xxhash64(F.lit(seed), *ids.columns), F.lit(1 << 40))
    few = ids.withColumn("_u", u).where(F.col("_u") <= min(1 << 40, 2 * most * (1 << 40) // max(1, n)))
    return few.orderBy("_u", *ids.columns).limit(most).drop("_u")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, spread: Column, hot_parts: int = 20_000) -> DataFrame:
    """Left join of `facts`, one row a key, to `rows`, of which a few keys may hold most.

    `facts[n]` is the number of `rows` with that key. Keys with at least one of `hot_parts` parts of all rows are at
    most `hot_parts`, whatever the input, so they are broadcast (values should be some numbers or short texts); rows
    with such a key are dealt by `spread` instead of the key. So a task of the shuffled join has few rows of any one
    key as long as there are no more partitions than `hot_parts`. `facts` should be materialised: it is read thrice.
    """
    total = facts.agg(F.sum(n)).first()[0] or 0
    values = [c for c in facts.columns if c not in keys]
    hot = facts.where(F.col(n) * hot_parts >= total).select(*keys, F.struct(*values).alias("_hot"))
    cold = facts.where(F.col(n) * hot_parts < total).select(*keys, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")))
    joined = marked.join(cold, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values])

"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach, materialise, packed, repeated_ids, unpacked


def _num(x: int) -> Column:
    return F.expr(f"{x}BD")


_IDS = 1 << 65  # more than there are positions for an id


def _rank(n: Column, doc_id: Column) -> Column:
    """One number per row that is least for the longest text, then the smallest id, null ids last.

    A single decimal keeps the aggregation a hash aggregation; the least of a struct would sort the texts.
    """
    at = F.coalesce(doc_id.cast("decimal(20,0)") + _num(1 << 63), _num(1 << 64))
    return ((_num((1 << 31) - 1) - n.cast("decimal(10,0)")) * _num(_IDS) + at).cast("decimal(38,0)")


def _normalised(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n"), F.regexp_replace(text, f"{SPACE}+", "").alias("body"))
    return body.withColumn("digest", F.sha2("body", 256))


def winners(docs: DataFrame, salts: int = 16) -> DataFrame:
    """digest, keep_id, keep_n, group_size of each group of equal texts.

    Equal rows of a task meet first (the partial aggregation), then those of a salt, then the winners of the salts;
    each of the three steps groups by the whole normalised text, the digest only deals rows out. No step holds more
    than `salts` rows of a group. Should two texts ever share a digest, the job fails instead of merging them.
    """
    base = _normalised(docs).select(F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)).alias("salt"), "digest", "body", _rank(F.col("n"), F.col("doc_id")).alias("rank"))
    salted = base.groupBy("salt", "digest", "body").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("size"))
    whole = salted.repartition("digest").groupBy("digest", "body").agg(F.min("rank").alias("rank"), F.sum("size").alias("size"))
    one = whole.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    at = F.col("rank") % _num(_IDS)
    keep = F.when(at < _num(1 << 64), (at - _num(1 << 63)).cast("long"))
    n = (F.lit((1 << 31) - 1) - F.expr(f"rank div {_IDS}BD")).cast("int")
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast("long")).otherwise(F.col("group_size"))
    return one.select("digest", keep.alias("keep_id"), n.alias("keep_n"), checked.alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (see common.SPACE); null counts as empty, and empty texts
    are one group. Of equal texts the longest original, then the smallest doc_id stays; a null doc_id loses every
    tie. Rows that repeat the keeper's doc_id and length are ties without a difference: all are marked kept. An
    empty table gives an empty result. Only doc_id and text are read, so other columns can have any name.
    """
    facts = materialise(winners(docs, salts), "exact")
    rows = _normalised(docs).select("doc_id", "n", "digest")
    out = attach(rows, facts, ["digest"], "group_size", F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, salts: int = 16) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns unchanged.

    The groups and the row that stays are those of exact_dedup; null counts as empty, a null doc_id loses every tie.
    Of rows that repeat the keeper's doc_id and length, one stays: that of the least hash of its original text. An
    empty table gives an empty result; other columns than doc_id and text may have any name and type.
    """
    facts = materialise(winners(docs, salts), "exact").where(F.col("group_size") > 0)
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = packed(docs).select("doc", F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256).alias("digest"), F.char_length(text).alias("n"), F.col("doc.doc_id").cast("long").alias("id"))
    kept = facts.select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), F.col("keep_n").alias("m"))
    on = (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("k")) & (F.col("n") == F.col("m"))
    found, again = rows.join(kept, on, "left_semi"), repeated_ids(docs)
    if again is None:  # then no two rows tie
        return unpacked(found, docs.columns)
    single = found.join(again, F.col("id").eqNullSafe(F.col("again")), "left_anti").select("doc")
    tied = found.join(again, F.col("id").eqNullSafe(F.col("again")), "left_semi").groupBy("digest").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc")
    return unpacked(single.union(tied), docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""

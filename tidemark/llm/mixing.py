"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size -> also target, by capped water-filling.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all sizes. A source takes
    min(cap, level * weight): with sources ordered by cap / weight, the level follows from running sums, which is
    where clamping and resharing the excess again and again ends. One row per source, which is all that is ordered
    globally. If even all caps fall short of the share, every source takes its cap. Sources without words get 0.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    base = ranked.withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(float(max_epochs))}).withColumns({"_total": F.sum("source_size").over(every) * F.lit(float(share)), "_ratio": F.col("_cap") / F.col("_w")})
    order = Window.orderBy("_ratio", "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = base.withColumns({"_level": (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))})
    # the first source in order whose cap is above the level that the earlier ones leave sets the level of all
    level = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("_at", level).select("source", "source_size", F.when(F.col("_at").isNull() | (F.col("_ratio") <= F.col("_at")), F.col("_cap")).otherwise(F.col("_at") * F.col("_w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, digits: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts the words of the whole text (null: 0). A source with target t and size s takes every document
    floor(t / s) times, and in a seeded order (MD5 of seed and doc_id) as many once more as the rest of the target
    needs; the document at the boundary is taken in part, so that a source's words differ from its target by less
    than one. The order is cut into 16**digits ranges by the first hex digits: the ranges' sums give each range its
    start and the rest is ordered inside a range, so that no task orders a whole source. Null doc_ids are ordered
    as the empty string; rows with equal doc_id are ordered by size, and equal ones are alike. An empty table gives
    an empty result. Only doc_id, text and source are read. Reruns agree, whatever the partitions.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("_key")).withColumn("_range", F.substring("_key", 1, digits))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    by_source = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_sum").over(by_source), F.lit(0)))
    goal = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, max_epochs)
    facts = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("_source"), F.col("s._range").alias("_r"), "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(facts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start") - F.col("_in")))
    return joined.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), "source")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio, (SELECT sum(source_size) FROM w) * 1.5::DOUBLE AS total,
             (SELECT sum(w) FROM w) AS ws FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (ws - coalesce(sum(w) OVER b, 0)) AS lv FROM c
      WINDOW b AS (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, cap, ratio, w, (SELECT arg_min(lv, ratio) FROM l WHERE lv <= ratio) AS lvl FROM l),
g AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR ratio <= lvl THEN cap ELSE lvl * w END AS target FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(coalesce(floor(g.target / nullif(g.source_size, 0)), 0) * p.size + greatest(0, least(p.size,
         round(g.target - coalesce(floor(g.target / nullif(g.source_size, 0)), 0) * g.source_size) - before)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""

"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """links (a, b), any order and repeats -> node, root: root is the least node reachable, for each node that has a link.

    Each round links every node to the least of its neighbours, first from above, then from below; the rounds grow
    with the logarithm of the longest chain. Edges never outnumber the links by more than the nodes, and are written
    to the shared folder after each round; only their number and a checksum reach the driver.
    """
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = tuple(sign)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        # a hub has most edges of a large component: they are dealt out, see attach
        least = materialise(both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n"), "least")
        large = attach(both, least, ["x"], "n", F.col("y")).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # a node above many others has as many links here, until the next round: adaptive execution splits such a side of the join
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.where("u <> v").distinct(), "edges")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")

"""Merkle manifest of a dataset: subtrees by source, proofs and their folding, block by block."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, HEIGHT = 3, 7


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def above(nodes: list[str], fanout: int) -> list[str]:
    return [digest("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]


def levels(nodes: list[str], n: int, fanout: int, height: int) -> list[list[str]]:
    """The levels of a block, its lowest first, its top left out: `height` of them if its tree has more nodes than a block, else those until one is left."""
    out = []
    while len(out) < height if n > fanout**height else len(nodes) > 1:
        out.append(nodes)
        nodes = above(nodes, fanout)
    return [*out, nodes]


def path_of(at: int, below: list[list[str]], fanout: int) -> list[str]:
    """A step for each level of a block: the siblings of the node over place `at`, as 'those to the left|those to the right'."""
    steps = []
    for nodes in below:
        run, k = nodes[at // fanout * fanout : at // fanout * fanout + fanout], at % fanout
        steps.append("".join(run[:k]) + "|" + "".join(run[k + 1 :]))
        at //= fanout
    return steps


def folded(leaf: str, steps: list[str]) -> str:
    for s in steps:
        left, right = s.split("|")
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(fields: list[Column]) -> Column:
    """The digest of some fields, each '-' if null, else its length in bytes, a colon and its value."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place among the rows of the same `tree` by `order`, nulls first, and n, how many there are.

    Rows are dealt by ranges of tree and order, so a large tree is many tasks; a row's place is its place in its part, and the
    number of rows of its tree in the parts before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "dealt")
    own = Window.partitionBy("tree")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("start"))
    before = F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("m").over(own).alias("n"))
    return dealt.join(counts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _tops(rows: DataFrame, fanout: int, height: int) -> DataFrame:
    """tree, pos, n, node: the top of each block of the rows' trees, as the nodes of the next trees."""
    wide = fanout**height

    def top(block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.sort_values("pos")["node"].tolist()
        n, pos = int(block["n"].iloc[0]), int(block["pos"].iloc[0]) // wide
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "pos": pos, "n": -(-n // wide), "node": levels(nodes, n, fanout, height)[-1]})

    blocks = rows.select("tree", "pos", "n", "node", F.expr(f"pos div {wide}").alias("block"))
    return materialise(blocks.groupBy("tree", "block").applyInPandas(top, "tree string, pos long, n long, node string"), "tops")


def _grown(rows: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """The tables of nodes from rows (tree, pos, n, node) up to the one with one node a tree; a table has so much fewer rows than the one before as a block holds."""
    out = [rows]
    while not out[-1].where("n > 1").isEmpty():
        out.append(_tops(out[-1], fanout, height))
    return out


def _outer(rows: DataFrame, tops: DataFrame, fanout: int, height: int) -> DataFrame:
    """tree, pos, path, subroot of each node: cogrouped by block with the path of the block's top, tops (tree, pos, path, subroot)."""
    wide = fanout**height

    def finish(block: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        below = levels(block["node"].tolist(), int(block["n"].iloc[0]), fanout, height)[:-1]
        rest = top["path"].iloc[0].split(";") if top["path"].iloc[0] else []
        return pd.DataFrame({"tree": block["tree"], "pos": block["pos"], "path": [";".join([*path_of(k, below, fanout), *rest]) for k in range(len(block))], "subroot": top["subroot"].iloc[0]})

    blocks = rows.select("tree", "pos", "n", "node", F.expr(f"pos div {wide}").alias("block")).groupBy("tree", "block")
    return blocks.cogroup(tops.groupBy("tree", "pos")).applyInPandas(finish, "tree string, pos long, path string, subroot string")


def merkle_manifest(docs: DataFrame, received: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as lowercase hex.

    A document's leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each with its length. By source, leaves
    in order of doc_id are digested in runs of `fanout`, level by level, until the source's subroot is left, and the
    subroots in order of source likewise until the root is. proof_sha256 is the digest of all siblings from the leaf to the
    root. folded_root is what the proof and the leaf of the text as received give (`received`, an expression
    over the columns; as it stands if None), verified whether that is the root.

    Trees are cut into blocks of `height` levels. A first pass reduces each block to its top, and the tops, again in blocks,
    to the subroots and the root. Then leaves and the path from their block's top to the root, found the same way from above, meet by
    block, which finishes the levels inside the block, joins the proofs and folds them. So no task holds more than a
    block of `fanout ** height` rows, whatever the size of a source.

    Null sources are one source, before the others. Null doc_ids stand first in a source, rows that repeat a doc_id by their leaf; a
    field that is null differs from an empty one. A lone leaf is its subroot, a lone subroot the root; without siblings the
    proof is empty. An empty table gives an empty result. Only the five columns and those of `received` are read.
    """
    if fanout < 2 or height < 1:
        raise ValueError("a run has two nodes at least, a block one level")
    text = F.col("text").cast("string")
    own = [F.col(f).cast("string") for f in FIELDS[:4]]
    tree = F.coalesce(F.concat(F.lit("="), own[1]), F.lit("-"))  # null before any text, by bytes
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_of([*own, text]).alias("node"), leaf_of([*own, text if received is None else received.cast("string")]).alias("told"))
    made = materialise(made.withColumn("told", F.when(F.col("told") != F.col("node"), F.col("told"))), "leaves")
    leaves = materialise(placed(made, ["doc_id", "node"]), "placed")
    grown = _grown(leaves, fanout, height)
    subroots = grown[-1].select("tree", "node")
    whole = materialise(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"]), "subroots")
    over = _grown(whole, fanout, height)
    found = over[-1].select("node").first()
    root = found[0] if found else ""
    outer = over[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"))
    for rows in over[-2::-1]:
        outer = _outer(rows, outer, fanout, height)
    named = whole.select("pos", F.col("name"), F.col("node").alias("of")).join(outer.select("pos", "path"), "pos")
    outer = materialise(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("of").alias("subroot")), "outer")
    for rows in grown[-2:0:-1]:
        outer = materialise(_outer(rows, outer, fanout, height), "outer")
    return _finished(leaves, outer, root, fanout, height)


def _finished(leaves: DataFrame, outer: DataFrame, root: str, fanout: int, height: int) -> DataFrame:
    """The manifest's rows from leaves (tree, pos, n, node, told, doc_id) and the paths of their blocks."""
    wide, shape = fanout**height, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def finish(block: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        below = levels(block["node"].tolist(), int(block["n"].iloc[0]), fanout, height)[:-1]
        rest = top["path"].iloc[0].split(";") if top["path"].iloc[0] else []
        proofs, ends = [], []
        for k, (node, told) in enumerate(zip(block["node"], block["told"], strict=True)):
            steps = [*path_of(k, below, fanout), *rest]
            proofs.append(digest("".join(steps).replace("|", "")))
            ends.append(folded(told if isinstance(told, str) else node, steps))
        return pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["node"], "subroot": top["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": ends, "verified": [e == root for e in ends]})

    # as text: a long column with nulls would reach pandas as floating point
    rows = leaves.select("tree", "pos", "n", "node", "told", F.col("doc_id").cast("string").alias("doc_id"), F.expr(f"pos div {wide}").alias("block"))
    done = rows.groupBy("tree", "block").cogroup(outer.groupBy("tree", "pos")).applyInPandas(finish, shape)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


#: The same rows, of the query's parameters, by plain comparison.
ORACLE = r"""
WITH RECURSIVE bytes AS (SELECT doc_id, source, lang, n_chars, text, CAST(doc_id AS VARCHAR) AS id FROM documents),
crc AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: CAST(ascii(substr(id, CAST(i AS INT), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM bytes),
told AS (SELECT *, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS got FROM crc),
f AS (SELECT doc_id, source, got IS DISTINCT FROM text AS cut, concat(
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
  coalesce(strlen(text) || ':' || text, '-') AS a, coalesce(strlen(got) || ':' || got, '-') AS b FROM told),
leaf AS (SELECT doc_id, source, sha256(head || a) AS leaf, sha256(head || b) AS told FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
low AS (SELECT source, 0 AS lv, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL SELECT source, lv + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM low WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM low WHERE len(nodes) = 1),
high AS (SELECT 0 AS lv, list(subroot ORDER BY pos) AS nodes FROM sub
  UNION ALL SELECT lv + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], ''))) FROM high WHERE len(nodes) > 1),
steps AS (SELECT p.source, p.pos, p.doc_id, p.leaf, lv, nodes[p.pos // CAST(pow(3, lv) AS BIGINT) // 3 * 3 + 1 : p.pos // CAST(pow(3, lv) AS BIGINT)] AS l, nodes[p.pos // CAST(pow(3, lv) AS BIGINT) + 2 : p.pos // CAST(pow(3, lv) AS BIGINT) // 3 * 3 + 3] AS r
  FROM placed p JOIN low ON p.source IS NOT DISTINCT FROM low.source WHERE len(nodes) > 1),
tops AS (SELECT s.source, s.subroot, lv, nodes[s.pos // CAST(pow(3, lv) AS BIGINT) // 3 * 3 + 1 : s.pos // CAST(pow(3, lv) AS BIGINT)] AS l, nodes[s.pos // CAST(pow(3, lv) AS BIGINT) + 2 : s.pos // CAST(pow(3, lv) AS BIGINT) // 3 * 3 + 3] AS r FROM sub s, high WHERE len(nodes) > 1),
paths AS (SELECT source, pos, list({'l': array_to_string(l, ''), 'r': array_to_string(r, '')} ORDER BY lv) AS path FROM steps GROUP BY source, pos),
outers AS (SELECT source, list({'l': array_to_string(l, ''), 'r': array_to_string(r, '')} ORDER BY lv) AS path FROM tops GROUP BY source),
whole AS (SELECT p.doc_id, p.leaf, p.told, s.subroot, list_concat(coalesce(a.path, []), coalesce(o.path, [])) AS path FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
  LEFT JOIN paths a ON a.source IS NOT DISTINCT FROM p.source AND a.pos = p.pos LEFT JOIN outers o ON o.source IS NOT DISTINCT FROM p.source),
done AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
  list_reduce(list_prepend({'l': '', 'r': told}, path), lambda x, y: {'l': '', 'r': sha256(y.l || x.r || y.r)}).r AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM done
"""

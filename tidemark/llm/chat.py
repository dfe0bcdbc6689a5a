"""Preference formatting of conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column) -> Column:
    """start-end of the assistant's words in the rendered turns, code points, end exclusive, comma-separated."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.char_length(t["role"]) + F.char_length(t["text"]) + 13).alias("at"),
        F.when(t["role"] == "assistant", F.concat(acc["said"], F.array(F.concat((acc["at"] + F.char_length(t["role"]) + 5).cast("string"), F.lit("-"), (acc["at"] + F.char_length(t["role"]) + 5 + F.char_length(t["text"]) + 7).cast("string"))))).otherwise(acc["said"]).alias("said"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("said"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["said"], ","))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, shared_turns, prompt, chosen, rejected, chosen_mask, rejected_mask from rows pair_id, side, turn, role, text.

    `side` is chosen or rejected. The prompt is the longest common prefix of turns (equal role and text at each
    place), rendered once; the rest of either side is a completion, and its mask lists the spans that count in
    training: the assistant's text with its end mark. A turn is `<|role|>` newline, text, `<|end|>` newline. Null
    roles and texts are empty, turns are ordered by (turn, role, text), null turns first, and repeated rows are
    repeated turns. A pair of which one side has no turns has an empty prompt and that completion empty; a null
    pair_id is a pair like others. An empty table gives an empty result; other columns than those five aren't read.
    """
    base = turns.select("pair_id", "side", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    said = lambda x: F.sort_array(F.collect_list(F.when(F.col("side") == x, F.col("t"))))
    both = base.where(F.col("side").isin("chosen", "rejected")).groupBy("pair_id").agg(said("chosen").alias("c"), said("rejected").alias("r"))
    differ = F.filter(F.sequence(F.lit(1), F.least(F.size("c"), F.size("r"))), lambda i: (F.element_at("c", i)["role"] != F.element_at("r", i)["role"]) | (F.element_at("c", i)["text"] != F.element_at("r", i)["text"]))
    shortest = F.least(F.size("c"), F.size("r"))
    shared = F.when(shortest == 0, 0).otherwise(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, shortest))
    cut = both.withColumn("shared_turns", shared.cast("int"))
    rest = lambda x: F.slice(x, F.col("shared_turns") + 1, F.greatest(F.size(x) - F.col("shared_turns"), F.lit(0)))
    parts = cut.select("pair_id", "shared_turns", F.slice("c", F.lit(1), F.col("shared_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return parts.select("pair_id", "shared_turns", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _spans(F.col("c")).alias("chosen_mask"), _spans(F.col("r")).alias("rejected_mask"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations: each is chosen once, against its first half continued as its neighbour goes on.

    The neighbour of conversation 2k is 2k + 1 and the reverse; the halves part at half the number of turns, rounded
    up. Turns are numbered from 0 in the order of (turn, role, text), null turns first, so that it doesn't matter where
    a table's numbers begin; null roles and texts count as empty, repeated rows are repeated turns. A conversation without a
    neighbour is rejected with its first half alone. Rows with a null conv_id are left out, as they belong to no
    conversation; an empty table gives an empty result; other columns than those four aren't read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    each = Window.partitionBy("conv_id")
    nth = F.row_number().over(each.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    turns = rows.withColumns({"nth": nth.cast("long"), "pivot": F.ceil(F.count(F.lit(1)).over(each) / 2)})
    said = lambda df, pair, side: df.select(F.col(pair).alias("pair_id"), F.lit(side).alias("side"), F.col("nth").alias("turn"), "role", "text")
    pivots = rows.groupBy(F.col("conv_id").alias("pair_id")).agg(F.ceil(F.count(F.lit(1)) / 2).alias("at"))
    other = turns.withColumn("pair_id", F.col("conv_id").bitwiseXOR(F.lit(1))).join(pivots, "pair_id").where("nth >= at")
    return said(turns, "conv_id", "chosen").union(said(turns.where("nth < pivot"), "conv_id", "rejected")).union(said(other, "pair_id", "rejected"))


ORACLE = """
WITH v AS (SELECT conv_id, ceil(count(*) / 2.0) AS half FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL SELECT c.conv_id, 'rejected', turn, role, text FROM c JOIN v USING (conv_id) WHERE turn < half
  UNION ALL SELECT v.conv_id, 'rejected', turn, role, text FROM c JOIN v ON v.conv_id = xor(c.conv_id, 1) WHERE turn >= half),
n AS (SELECT pair_id, side, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM t),
s AS (SELECT pair_id, CAST(least(coalesce(min(i) FILTER (WHERE NOT same), 1000000) - 1, min(m)) AS INT) AS shared_turns FROM (
        SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
               coalesce(a.role = b.role AND a.text = b.text, false) AS same, 1000000 AS m
        FROM (SELECT * FROM n WHERE side = 'chosen') a FULL JOIN (SELECT * FROM n WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.i = b.i) GROUP BY 1),
g AS (SELECT s.pair_id, s.shared_turns FROM s),
z AS (SELECT g.pair_id, least(g.shared_turns, (SELECT count(*) FROM n WHERE n.pair_id = g.pair_id AND side = 'chosen'),
             (SELECT count(*) FROM n WHERE n.pair_id = g.pair_id AND side = 'rejected')) AS shared_turns FROM g),
r AS (SELECT n.pair_id, side, i, n.role, z.shared_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x, length(text) AS len
      FROM n JOIN z ON n.pair_id = z.pair_id),
o AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM r WHERE i > shared_turns)
SELECT z.pair_id, CAST(z.shared_turns AS INT) AS shared_turns,
  coalesce((SELECT string_agg(x, '' ORDER BY i) FROM r WHERE r.pair_id = z.pair_id AND side = 'chosen' AND i <= z.shared_turns), '') AS prompt,
  coalesce((SELECT string_agg(x, '' ORDER BY i) FROM o WHERE o.pair_id = z.pair_id AND side = 'chosen'), '') AS chosen,
  coalesce((SELECT string_agg(x, '' ORDER BY i) FROM o WHERE o.pair_id = z.pair_id AND side = 'rejected'), '') AS rejected,
  coalesce((SELECT string_agg((off + length(role) + 5)::BIGINT || '-' || (off + length(role) + 12 + len)::BIGINT, ',' ORDER BY i) FROM o WHERE o.pair_id = z.pair_id AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg((off + length(role) + 5)::BIGINT || '-' || (off + length(role) + 12 + len)::BIGINT, ',' ORDER BY i) FROM o WHERE o.pair_id = z.pair_id AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM z
"""

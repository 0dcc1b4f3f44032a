"""Chat formatting: logged snapshots of a growing conversation collapse to the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.session import materialise


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, h1, h2, last): a 128-bit rolling hash of every prefix of every conversation.

    Each turn is hashed together with its position; a prefix is the running exclusive-or of its turns, so one window gives all
    of them. Turns are ordered by turn, then role, then text, nulls first; equal turns stay in place of one another. Rows
    without conv_id are one conversation.
    """
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    seen = turns.select("conv_id", "turn", "role", "text").withColumn("position", F.row_number().over(ordered))
    keys = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    seen = seen.withColumn("_a", F.xxhash64(F.lit(1), *keys)).withColumn("_b", F.xxhash64(F.lit(2), *keys))
    return seen.select("conv_id", "position", F.bit_xor("_a").over(upto).alias("h1"), F.bit_xor("_b").over(upto).alias("h2"),
                       F.lead("position").over(ordered).isNull().alias("last"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that are no prefix of a longer one; of equal ones the smallest id stays.

    Equal conversations are one row before the anti-join, and equal prefixes too, so neither a conversation logged very often
    nor a very common first turn is a hot key.
    """
    seen = materialise(prefixes(turns), "prefixes")
    whole = seen.filter("last").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = seen.filter("not last").select("position", "h1", "h2").distinct()
    kept = whole.join(inner, ["position", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("position").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies, chat) of the maximal conversations of `turns` (conv_id, turn, role, text, ...).

    A null role is rendered as unknown, a null text as empty. The text of a conversation is one value, so its turns meet in
    one task; dropped snapshots are removed before. An empty table gives an empty one.
    """
    kept = maximal(turns).alias("k")
    t = turns.select("conv_id", "turn", "role", "text").alias("t")
    joined = t.join(kept, F.expr("t.conv_id <=> k.conv_id")).select("t.*", "k.n_turns", "k.copies")
    each = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role",
                                                F.col("text").isNotNull().alias("c"), "text")))
    grouped = joined.groupBy("conv_id", "n_turns", "copies").agg(each.alias("turns"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", lambda x: rendered(x["role"], x["text"])), "").alias("chat"))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations
), p AS (
  SELECT conv_id, pos, string_agg(coalesce(length(role)::text, '-') || ':' || coalesce(role, '') || coalesce(length(text)::text, '-') || ':' || coalesce(text, ''), ';')
           OVER (PARTITION BY conv_id ORDER BY pos) AS prefix,
         lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS last
  FROM t
), w AS (
  SELECT prefix, min(conv_id) AS conv_id, max(pos) AS n_turns, count(*) AS copies FROM p WHERE last GROUP BY prefix
), k AS (
  SELECT * FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE NOT last)
)
SELECT k.conv_id, k.n_turns::int AS n_turns, k.copies,
       string_agg('<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS chat
FROM k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.copies
"""

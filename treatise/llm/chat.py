"""Chat formatting: cumulative snapshots of a conversation collapse into the longest one before rendering.

A log often holds the same conversation again and again, each time with a few turns more. The hash of a prefix is
a running xor of turn hashes that include the turn's rank, so it depends on roles, texts and order. A conversation
whose whole hash is the hash of a proper prefix of another is dropped by an anti-join; of equal conversations the
one with the smallest conv_id stays. What stays is rendered as <|role|> and text, one line end between turns.

Ranks and prefixes are computed in blocks of `BLOCK` turns (by turn number) with the blocks' totals carried over,
and a conversation is rendered in parts of at most one block; no task needs a whole conversation.

Defined cases: null role or text is empty; a null turn comes first; rows that repeat (conv_id, turn, role, text)
count once; rows without conv_id are left out; turns with one number are ordered by role and text, and are one block
however many they are; of equal conversations the smallest conv_id stays; texts may have any length; an empty table
gives an empty result; other columns are not read, so these may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import settle

BLOCK = 256


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, rank (1 up), role, text and the hashes pa, pb of the conversation up to this turn."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-(2**40))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).dropDuplicates(["conv_id", "turn", "role", "text"])
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    ranked = rows.join(counts.select("conv_id", "block", "before"), ["conv_id", "block"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    hashed = ranked.withColumn("ha", F.xxhash64("rank", "role", "text")).withColumn("hb", F.xxhash64("text", "role", "rank", F.lit("b")))
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    totals = totals.select("conv_id", "block", *(F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(c) for t, c in (("ta", "ca"), ("tb", "cb"))))
    running = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = hashed.join(totals, ["conv_id", "block"])
    return out.select("conv_id", "block", "rank", "role", "text", *(F.col(c).bitwiseXOR(F.bit_xor(h).over(running)).alias(p) for c, h, p in (("ca", "ha", "pa"), ("cb", "hb", "pb"))))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations, itself included) of those that are no prefix of another."""
    n = hashed.groupBy("conv_id").agg(F.max(F.struct("rank", "pa", "pb")).alias("last")).select("conv_id", "last.*")
    whole = n.groupBy("rank", "pa", "pb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    last = n.select("conv_id", F.col("rank").alias("n_turns"))
    # Prefixes become distinct before the join, so a first turn that many share is one row on each side.
    prefixes = hashed.join(last, "conv_id").where(F.col("rank") < F.col("n_turns")).select("rank", "pa", "pb").distinct()
    return whole.join(prefixes, ["rank", "pa", "pb"], "left_anti").select("conv_id", F.col("rank").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered for each maximal conversation; part counts blocks from 0."""
    hashed = settle(prefix_hashes(turns))
    kept = maximal_conversations(hashed)
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    parts = hashed.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("rendered"))
    order = Window.partitionBy("conv_id").orderBy("block")
    numbers = hashed.select("conv_id", "block").distinct().withColumn("part", F.row_number().over(order) - 1)
    return parts.join(numbers, ["conv_id", "block"]).join(kept, "conv_id").select("conv_id", "part", "n_turns", "n_copies", "rendered")

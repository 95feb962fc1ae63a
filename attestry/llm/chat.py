"""Chat formatting with cumulative snapshots collapsed.

Chat logs often hold a conversation again after every turn. Each turn is hashed with its place, and the hash
of a prefix is the running exclusive-or of its turns' hashes (two of them, 128 bits), so every conversation
has the hashes of all its prefixes after one window. A conversation whose whole hash is that of a shorter
prefix of another one is a snapshot: an anti-join takes it out, and only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, 1 on, with their prefix hashes ``p1`` and ``p2`` and ``n_turns`` of the conversation."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(order))
    turns = turns.withColumns({"h1": F.xxhash64("place", "role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "place", "role")})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumns(
        {"p1": F.bit_xor("h1").over(running), "p2": F.bit_xor("h2").over(running), "n_turns": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))}
    ).drop("h1", "h2")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_logged`` of the conversations that no longer one begins with; of equal ones the
    smallest id, ``n_logged`` of them."""
    whole = turns.where("place = n_turns").groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    longer = turns.where("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(longer, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_logged")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``n_logged`` and ``rendered`` of all maximal conversations.

    A turn is rendered as ``<|role|>``, a newline, its text and a newline. Turns go by ``turn``, then role and
    text where that is equal or null (null first); a null role or text is empty. Rows without ``conv_id`` are
    turns of no conversation and left out. Other columns are not read.
    """
    turns = numbered_turns(conversations)
    kept = maximal_conversations(turns)
    rows = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    piece = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))
    return rows.select("conv_id", "n_turns", "n_logged", F.array_join(F.transform("turns", piece), "").alias("rendered"))


def op9_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

"""Chat formatting with cumulative-snapshot collapse.

A log often holds every state of a conversation: the first turn, then the
first three, and so on. Only maximal conversations are worth rendering.

1. Turns of a conversation are ordered and hashed with their position; the
   running xor of two independent 64-bit hashes is the rolling hash of the
   turn prefix (one window over the conversation's own turns).
2. A conversation is collapsed when another, longer one has its whole hash as
   the prefix of the same length. Prefixes are made distinct first (a partial
   aggregate), then an anti-join retains the maximal conversations. Equal
   conversations keep the smallest conv_id.
3. The remaining conversations are rendered with the template.

Edge cases: rows without conv_id belong to no conversation and are left out.
Repeated rows (same conversation, turn, role and text) count once. Turns with
equal (or null) ``turn`` are ordered null first, then by role and text. A null
text is an empty one, a null role is ``unknown``. Template markers inside a
text are broken up with a space, so content cannot open or close a turn.
Extra columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): ordered turns with the hash of the prefix they end."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = (F.lag("text").over(w).eqNullSafe(F.col("text")) & F.lag("role").over(w).eqNullSafe(F.col("role"))
            & F.lag("turn").over(w).eqNullSafe(F.col("turn")) & (F.row_number().over(w) > 1))
    once = rows.withColumn("same", same).filter("NOT same").drop("same")
    placed = once.withColumn("pos", F.row_number().over(w))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv_id", "pos", "role", "text",
        F.bit_xor(F.xxhash64(F.lit(11), "pos", "role", "text")).over(running).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(23), "text", "role", "pos")).over(running).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that prefix no longer one, the smallest id of equal ones."""
    last = prefixes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    tagged = prefixes.join(last, "conv_id")
    whole = (tagged.filter("pos = n_turns").groupBy("n_turns", "h1", "h2")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal")))
    inner = tagged.filter("pos < n_turns").select(F.col("pos").alias("n_turns"), "h1", "h2").distinct()
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def _safe(text: Column) -> Column:
    for marker in (OPEN, CLOSE):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("<|", "<| ")))
    return text


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, n_trained, text) of every maximal conversation.

    ``n_trained`` counts the assistant's characters, the part a loss mask keeps.
    """
    prefixes = materialise(turn_prefixes(turns))
    kept = maximal(prefixes)
    content = _safe(F.col("text"))
    piece = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), content, F.lit(CLOSE), F.lit("\n"))
    return (prefixes.join(kept, "conv_id")
            .groupBy("conv_id", "n_turns", "n_equal")
            .agg(F.sum(F.when(F.col("role") == "assistant", F.length(content)).otherwise(0)).alias("n_trained"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))),
                                          lambda s: s["piece"]), "").alias("text")))

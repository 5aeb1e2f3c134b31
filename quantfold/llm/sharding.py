"""Sharding as vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group and go to one shard. Only a group above a whole
shard's share ``1 / shards`` of some measure is split, by hash of the id, into
pieces of about a ``pieces``-th of a share. A group above ``1 / (shards *
bundles)`` of some measure is placed by itself; the many smaller ones are
bundled by hash of their text. What is packed is the table of pieces, groups
and bundles, whose size depends on ``shards``, ``pieces`` and ``bundles`` alone
(at most ``3 * shards * bundles`` groups are that large), so the driver's list
is bounded.

Items are placed from large to small; each goes to the shard where the dot
product of its measures with the shard's residual capacity is highest. The
law of the result is ``bytes``: near equal sizes, so bytes weigh more in it.

Slots are numbered without one task per shard: rows are numbered inside
(shard, part), parts hold about ``slots_a_part`` rows, and the parts' counts
are summed ahead.

Edge cases: a null text has no bytes (size 1) and is a group with the other
null and empty texts. Repeated rows and equal ids get slots of their own. An
empty table gives no rows. One text larger than a shard's share makes its
shard larger. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import SPACE, materialise


#: Weights of bytes, tokens and rows in the dot product: the law of the result is bytes.
WEIGHTS = np.array([50.0, 1.0, 1.0])


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item; ``items`` holds each one's share of every measure."""
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -items.sum(1), -items.max(1))):
        out[i] = int(np.argmax(residual @ (WEIGHTS * items[i])))
        residual[out[i]] -= items[i]
    return out


def assign(docs: DataFrame, *, shards: int = 16, bundles: int = 256, pieces: int = 32, slots_a_part: int = 5000) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard, slot for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    rows = materialise(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE))).otherwise(0).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.lit(1)).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2")))
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(F.col("size") / total["size"], F.col("tokens") / max(1, total["tokens"]), F.col("rows") / total["rows"])
    large = (rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
             .filter((share > 1.0 / (shards * bundles)) & (F.col("rows") > 1))
             .select("g1", "g2", F.when(share > 1.0 / shards, F.ceil(share * shards * pieces)).otherwise(F.lit(1)).alias("parts")))
    # at most 3 * shards * bundles groups exceed the share: safe to broadcast
    itemised = materialise(rows.join(F.broadcast(large), ["g1", "g2"], "left").withColumn(
        "item", F.when(F.col("parts").isNull(), F.pmod(F.col("g1"), F.lit(shards * bundles))).otherwise(
            -1 - F.pmod(F.xxhash64("g1", "g2", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("parts"))), F.lit(1 << 62))))
        .drop("parts"))
    items = (itemised.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
             .toPandas().sort_values("item"))
    weights = items[["size", "tokens", "rows"]].to_numpy(np.float64)
    placed = pack(weights / np.maximum(weights.sum(0), 1.0), shards)
    where = spark.createDataFrame(list(zip(items["item"].tolist(), placed.tolist())), "item long, shard int")
    parts = -(-total["rows"] // (shards * slots_a_part))
    numbered = itemised.join(F.broadcast(where), "item").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(parts)))
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("ahead"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "g1", "g2"))
    return (numbered.withColumn("local", local).join(ahead, ["shard", "part"])
            .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("ahead") + F.col("local") - 1).alias("slot")))

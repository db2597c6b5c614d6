"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group is placed whole where the dot product of its
(bytes, tokens, rows) with the shards' residual capacity is highest, the largest
group first.  Two things make that work at any size:

* Only a group with more than a shard can take is cut, into pieces of nearly equal size,
  so one text that a third of all rows share still spreads evenly.
* Groups too large for a block, at most 3 * shards * PARTS for each block, are placed
  whole in one pass over all of them; the blocks fill up what room that leaves.
* The other groups are dealt by hash into blocks of at most ``BLOCK`` groups.  Each block
  has its part of every shard's room and is packed by a task of its own; as every
  block is balanced, so is their sum.  Bins are turned from block to block, so that
  what little imbalance blocks have does not add up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.storage import stored

#: Groups that a task packs at most.
BLOCK = 40_000
#: Parts of a shard's share in a block that a block's group or piece has at most.
PARTS = 32


def pack(sizes: np.ndarray, shards: int, room: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """The bin of each row of ``sizes`` (items x dimensions).

    Every bin has an equal part of the total (of sizes, if not given) in each dimension,
    or the part that room (bins x dimensions) says.  Items go largest first (by their
    largest share in any dimension, ties by row).
    """
    total = np.maximum(sizes.sum(axis=0) if total is None else total, 1e-300)
    share = sizes / total
    residual = np.full((shards, sizes.shape[1]), 1.0 / shards) if room is None else room.copy()
    bins = np.zeros(len(sizes), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        b = int((residual @ share[i]).argmax())
        residual[b] -= share[i]
        bins[i] = b
    return bins


def shard_documents(docs: DataFrame, shards: int = 16, block: int = BLOCK) -> DataFrame:
    """Deals all documents into shards of nearly equal size by the law ``bytes``.

    docs: has ``doc_id`` and ``text``; other columns are not read.  Returns ``doc_id, size``
    (bytes of the text in UTF-8 plus 1), ``text_crc32, law, shard, slot, grown_shard`` (null
    under this law).  A null text has no bytes, and null texts are a group.  Null and
    repeated doc_ids are rows like any other; slots go from 0 without gaps in each shard,
    by bucket and doc_id; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1).cast("long").alias("tokens"), F.xxhash64("text", F.col("text").isNull()).alias("h"), F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    dims = ["size", "tokens", "n"]
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    total = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in dims), F.count("*").alias("groups")).first()
    blocks = 1 + total["groups"] // block
    whole = np.array([float(total[d]) for d in dims])
    share = F.greatest(*(F.col(d) / max(1, total[d]) for d in dims))
    parts = shards * PARTS * blocks
    apart = groups.withColumns({"share": share, "pass": F.lit(0)}).filter(F.col("share") * parts > 1)
    hot = F.col("share") * shards > 1

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h")
        return g[["h", *dims]].assign(home=pack(g[dims].to_numpy(float), shards, total=whole))

    homes = stored(apart.filter(~hot).groupBy("pass").applyInPandas(settle, "h long, size long, tokens long, n long, home int"), "homes")
    room = np.tile(whole / shards, (shards, 1))
    for r in homes.groupBy("home").agg(*(F.sum(d).alias(d) for d in dims)).collect():  # a row a shard
        room[r["home"]] -= [float(r[d]) for d in dims]
    room = np.maximum(room, 0.0)
    room = np.where(room.sum(axis=0) > 0, room / np.maximum(room.sum(axis=0), 1e-300), 1.0 / shards)
    # written, so that Spark knows its size and broadcasts it only if it is small
    pieces = F.ceil(F.col("share") * parts)
    large = stored(
        apart.filter(hot).select(F.col("h").alias("large_h"), pieces.alias("pieces"), F.lit(None).cast("int").alias("home"))
        .unionByName(homes.select(F.col("h").alias("large_h"), F.lit(1).cast("long").alias("pieces"), "home")),
        "large",
    )
    dealt = rows.join(large, F.col("h") == F.col("large_h"), "left").drop("large_h")
    dealt = dealt.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(0))).drop("pieces")
    settled, dealt = dealt.filter("home is not null").withColumnRenamed("home", "shard"), dealt.filter("home is null").drop("home")
    items = dealt.groupBy("h", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    items = items.withColumn("block", F.pmod(F.xxhash64("h", "piece"), F.lit(blocks)))

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "piece"])
        turn = int(g["block"].iloc[0])
        sizes = g[dims].to_numpy(float)
        own = np.roll(room, -turn, axis=0) * sizes.sum(axis=0) / np.maximum(whole, 1e-300)  # the room for this block, in shares of the whole
        bins = (pack(sizes, shards, own, whole) + turn) % shards
        return pd.DataFrame({"h": g["h"], "piece": g["piece"], "shard": bins.astype("int32")})

    placed = items.groupBy("block").applyInPandas(place, "h long, piece long, shard int")
    buckets = 16 + total["n"] // 1_000_000
    sharded = stored(dealt.join(placed, ["h", "piece"]).unionByName(settled).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).drop("h", "piece", "tokens"), "sharded")
    before = sharded.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = before.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    return sharded.withColumn("at", slot).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

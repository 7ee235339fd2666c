"""Weighted rendezvous hashing of record keys over shards, in DataFrame expressions only.

Every (key, shard) pair has a pseudo-random number u in (0, 1); a key goes to the shard with the least ``-ln(u) / weight``.
A shard that is added takes only the keys for which it is now the least, one in n on average, and no key moves between old shards.
The plan: one projection over the texts finds the shard, and its few numbers per row are a written table; then slots are numbered in two levels, so no shard is ever gathered into one task: rows are counted
and ranked within (shard, cell), where the cell is one of 4096 ranges of a row's hash, and the cells' offsets are summed over at most
4096 rows per shard.

Defined results: a null key hashes as the word ``null`` and all such rows share a shard; a null text has no bytes and CRC 0, as the empty text has; repeated rows each take
a slot; rows equal in key, text CRC and size are interchangeable; an empty table gives no rows; columns other than the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

LAW = "key"
SHARDS = 24
#: Hex digits of a row's hash that choose its cell.
CELL_DIGITS = 3


def bids(key: Column, weights: Sequence[float]) -> Column:
    """One struct (cost, shard) for each shard. Weights must be positive; a weight of 2 wins twice the keys of a weight of 1."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    shards = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def bid(s: Column) -> Column:
        u = (F.conv(F.substring(F.md5(F.concat_ws(":", text, s["i"].cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
        return F.struct((-F.log(u) / s["w"]).alias("cost"), s["i"].alias("shard"))

    return F.transform(shards, bid)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that wins the key."""
    return F.array_min(bids(key, weights))["shard"]


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """key, size, text_crc32, law, shard, slot (gapless from 0 within a shard) and grown_shard (the shard once one of ``new_weight`` is added)."""
    bytes_ = F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(bytes_) + F.lit(8)).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        bids(F.col(key), [*weights, new_weight]).alias("_bids"),  # computed once for both shard counts
    ).select(
        "key",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        F.array_min(F.slice("_bids", 1, len(weights)))["shard"].alias("shard"),
        F.array_min("_bids")["shard"].alias("grown_shard"),
        F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("text_crc32")).cast("binary")), 1, CELL_DIGITS).alias("_cell"),
    )
    rows = Scratch(docs.sparkSession, "sharding").write(rows, "rows")
    cells = rows.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_cell").orderBy("key", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(offsets, ["shard", "_cell"]).select(F.col("key").alias(key), "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")

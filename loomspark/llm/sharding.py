"""Sharding by global byte-size prefix sums.

Rows keep the order of their scan.  Each block of consecutive rows of a scan partition is summed, block totals are summed
up by partition and partitions by groups of partitions, so that no window ever holds more than one block, the blocks of a
partition, or one group of partitions.  A row belongs to the shard in whose equal share of all bytes its middle byte lies:
shards are contiguous and differ from an equal share by less than one row at either end.

Only DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_id

#: Rows a block, and partitions a group of partitions, as powers of two.
BLOCK_BITS = 10
GROUP_BITS = 10
PARTITION_BITS = 33


def _before(df: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """Adds to each of ``sums`` a column ``<name>_in``: the sum of the rows before, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *(F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{s}_in") for s in sums))


def _lifted(low: DataFrame, high: DataFrame, keys: list[str]) -> DataFrame:
    """Starts of ``low`` within ``keys``, moved by the start of their key."""
    high = high.select(*keys, F.col("bytes_in").alias("_hb"), F.col("rows_in").alias("_hr"))
    out = low.join(high, keys)
    return out.withColumns({"bytes_in": F.col("bytes_in") + F.col("_hb"), "rows_in": F.col("rows_in") + F.col("_hr")}).drop("_hb", "_hr")


def prefix_sums(rows: DataFrame) -> DataFrame:
    """``rows`` has _rid (see row_id) and bytes; adds bytes_in and rows_in, the sums of all rows before in scan order."""
    pos = F.col("_rid").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    rows = rows.select("*", F.lit(1).cast("long").alias("rows"), F.shiftright("_rid", PARTITION_BITS).alias("_part"), F.shiftright(pos, BLOCK_BITS).alias("_block"))
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    blocks = cut(total(rows, "_part", "_block"))
    parts = total(blocks, "_part").withColumn("_group", F.shiftright("_part", GROUP_BITS))
    # One row for each 2^GROUP_BITS partitions; a window over the whole of this is the only unpartitioned step.
    groups = _before(total(parts, "_group").withColumn("_all", F.lit(0)), ["_all"], "_group", ["bytes", "rows"])
    parts = _lifted(_before(parts, ["_group"], "_part", ["bytes", "rows"]), groups, ["_group"])
    blocks = _lifted(_before(blocks, ["_part"], "_block", ["bytes", "rows"]), parts, ["_part"])
    return _lifted(_before(rows, ["_part", "_block"], "_rid", ["bytes", "rows"]), blocks, ["_part", "_block"])


def shard(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Contiguous shards of near-equal bytes: doc_id, size, text_crc32, shard, slot.

    A row weighs the UTF-8 bytes of its text plus ``overhead``.  Null text: no bytes and the checksum of no bytes.  Null or
    repeated doc_id: each row is its own and keeps its place.  No rows: no rows out.  Other columns are not read.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(body) + overhead).cast("long").alias("bytes"), F.crc32(body).alias("text_crc32"), row_id().alias("_rid"))
    rows = cut(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 1
    rows = prefix_sums(rows)
    # Twice the middle byte over twice the share of a shard, in decimals: bytes of 100 TB times shards pass 2^53.
    middle = (F.col("bytes_in") * 2 + F.col("bytes")).cast("decimal(30,0)") * n_shards
    placed = rows.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / F.lit(2 * total).cast("decimal(20,0)"))).cast("int"))
    placed = cut(placed.select("doc_id", F.col("bytes").alias("size"), "text_crc32", "shard", "rows_in"))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rows_in").alias("_first")))  # a row for each shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rows_in") - F.col("_first")).alias("slot"))

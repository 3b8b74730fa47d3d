"""Places in a total order and running sums along it, without putting all rows, or all of a segment, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows that one group of a running sum holds at most.
BLOCK = 4096


def placed(df: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of ``keys``; rows that tie on all of them stand in any order.

    Rows are sorted by ranges; a row's place is what the ranges before hold and its place in its own.
    """
    # the number of partition and row is part of what is written, so a task that is run again changes nothing
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    ahead, sizes = 0, []
    for r in sorted(rows.groupBy(part.alias("_part")).count().collect()):  # a row for each partition
        sizes.append((r["_part"], ahead))
        ahead += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(sizes, "_part long, _ahead long"))
    return rows.join(starts, part == F.col("_part")).withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_ahead")


def running(df: DataFrame, segment: list[str], place: str, **sums: Column) -> DataFrame:
    """``df`` with the sum of each expression over the rows of its segment up to and with itself, by ``place``.

    Blocks of BLOCK places are summed apart; a block starts with what the blocks of its segment before it hold.
    """
    block = F.floor(F.col(place) / BLOCK).cast("long")
    rows = df.withColumns({"_block": block, **{f"_{k}": v for k, v in sums.items()}})
    own = Window.partitionBy(*segment, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*segment).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*segment, "_block").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in sums))
    carried = blocks.select(*segment, "_block", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}_ahead") for k in sums))
    inside = rows.withColumns({k: F.sum(f"_{k}").over(own) for k in sums})
    match = [inside[c].eqNullSafe(carried[c]) for c in (*segment, "_block")]
    out = inside.join(carried, match)
    return out.select(*(inside[c] for c in df.columns), *((F.col(k) + F.col(f"_{k}_ahead")).alias(k) for k in sums))

"""Batch cuts over a whole table, longest rows first, without one task for all of it.

Where a batch that starts at a row ends depends on the next ``max_rows`` lengths only.  So a block of places, with the few rows
behind it, says for every row at which a batch may enter it where the batches then leave it for the next block, and how many have
started in it: a map of at most ``max_rows`` numbers.  Such maps compose.  Blocks are joined by FAN to larger ones, level by level,
and the way back down tells each block where it is entered and which batch that is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.places import placed
from ..functions.workers import ship
from .registry import query

BLOCK, FAN = 4096, 256


def sizes(lengths: np.ndarray, starts: int, max_rows: int, budget: int, extra: int, waste_percent: int) -> list[int]:
    """Rows of the batch that starts at each of the first ``starts`` places; lengths fall.

    A row joins while the batch has at most ``max_rows`` rows, rows times (longest plus ``extra``) is within ``budget``, and of rows
    times longest at most ``waste_percent`` is padding.  One row is always a batch.
    """
    total = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for i in range(starts):
        n, w = 1, int(lengths[i])
        while i + n < len(lengths) and n < max_rows:
            padded = w * (n + 1)
            if (w + extra) * (n + 1) > budget or 100 * (padded - int(total[i + n + 1] - total[i])) > waste_percent * padded:
                break
            n += 1
        out.append(n)
    return out


def through(next_of: list[int], size: int, entry: int) -> tuple[int, int]:
    """From an entry over the next starts: place in the next block where it is left for, and the starts passed."""
    at, n = entry, 0
    while at < size:
        at, n = at + next_of[at], n + 1
    return at - size, n


def batches(df: DataFrame, length: str, key: str, max_rows: int = 16, budget: int = 60_000, extra: int = 0, waste_percent: int = 25, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """key, length and batch (from 0) of every row of ``df``: longest first, ties by key; null lengths count as 0.

    ``max_rows`` is at most ``block``.  Rows that tie on both (repeated rows) stand in any order.  No rows: no rows out.
    """
    if not 0 < max_rows <= block:
        raise ValueError("max_rows must be between 1 and the size of a block")
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"))
    own = placed(rows, F.desc("length"), F.asc("key")).withColumn("block", F.floor(F.col("place") / block).cast("long"))
    # the first rows of a block are also seen by the block before
    behind = own.where((F.col("place") % block < max_rows) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    seen = cut(own.unionByName(behind))

    def lengths_of(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        part = part.sort_values("place", ignore_index=True)
        return part, part["length"].to_numpy(), int((part["place"] // block == part["block"]).sum())

    def mapped(part: pd.DataFrame) -> pd.DataFrame:
        part, all_of, size = lengths_of(part)
        nexts = sizes(all_of, size, max_rows, budget, extra, waste_percent)
        left = [through(nexts, size, e) for e in range(max_rows)]
        return pd.DataFrame({"block": part["block"].iloc[:1], "exits": [[x for x, _ in left]], "counts": [[n for _, n in left]]})

    schema = "block long, exits array<int>, counts array<long>"
    levels = [cut(seen.groupBy("block").applyInPandas(mapped, schema))]

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        at, counts = np.arange(max_rows), np.zeros(max_rows, dtype=np.int64)
        for r in part.sort_values("child").itertuples():
            counts += np.asarray(r.counts)[at]
            at = np.asarray(r.exits)[at]
        return pd.DataFrame({"block": [part["child"].iloc[0] // fan], "exits": [at.tolist()], "counts": [counts.tolist()]})

    while levels[-1].count() > 1:
        up = levels[-1].withColumnRenamed("block", "child").withColumn("up", F.floor(F.col("child") / fan))
        levels.append(cut(up.groupBy("up").applyInPandas(lambda part: composed(part), schema)))

    def descended(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        at, batch, out = int(part["up_entry"].iloc[0]), int(part["up_batch"].iloc[0]), []
        for r in part.itertuples():
            out.append((r.block, at, batch))
            at, batch = int(r.exits[at]), batch + int(r.counts[at])
        return pd.DataFrame(out, columns=["block", "entry", "batch"])

    entries = levels[-1].select("block", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("batch"))
    for level in reversed(levels[:-1]):
        above = entries.select(F.col("block").alias("up"), F.col("entry").alias("up_entry"), F.col("batch").alias("up_batch"))
        down = level.withColumn("up", F.floor(F.col("block") / fan)).join(above, "up")
        entries = cut(down.groupBy("up").applyInPandas(descended, "block long, entry int, batch long"))

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        entry, batch = int(part["entry"].iloc[0]), int(part["batch"].iloc[0])
        part, all_of, size = lengths_of(part)
        nexts = sizes(all_of, size, max_rows, budget, extra, waste_percent)
        out, at = np.full(size, batch - 1, dtype=np.int64), entry  # rows before the entry go with the batch that came in
        while at < size:
            out[at : at + nexts[at]] = batch
            at, batch = at + nexts[at], batch + 1
        return part.iloc[:size][["key", "length"]].assign(batch=out)

    return seen.join(entries, "block").groupBy("block").applyInPandas(numbered, f"key {kind}, length long, batch long").withColumnRenamed("key", key)


T07_SQL = """WITH RECURSIVE o AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id) AS i FROM documents),
    w AS (SELECT i, list(n) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS l FROM o),
    c AS (SELECT i, l, k, l[1] * k AS padded, list_sum(l[1:k]) AS used FROM (SELECT i, l, unnest(range(2, len(l) + 1)) AS k FROM w) x),
    bad AS (SELECT i, min(k) AS k FROM c WHERE padded > 60000 OR 100 * (padded - used) > 25 * padded GROUP BY i),
    s AS (SELECT w.i, w.i + coalesce(bad.k - 1, len(w.l)) AS nxt FROM w LEFT JOIN bad ON bad.i = w.i),
    r AS (SELECT 0::BIGINT AS batch, 1::BIGINT AS i UNION ALL SELECT batch + 1, s.nxt FROM r JOIN s ON s.i = r.i)
    SELECT doc_id, n AS n_chars, (SELECT max(batch) FROM r WHERE r.i <= o.i) AS batch FROM o"""


@query("T07_batch_packing", T07_SQL)
def packing(spark, sf_dir):
    """All documents, under 16 rows, 60,000 padded characters and a quarter of waste."""
    return batches(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", "doc_id").withColumnRenamed("length", "n_chars")

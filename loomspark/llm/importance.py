"""Importance resampling towards a target, on hashed word n-grams.

The ring.  Each word starts a zlib state; a state of one of the last ``n`` starts is extended by a space and the next word, so a
text is scanned once and no n-gram is ever put together as a string.  Words are taken by the block: all states of one age are
extended in a row, and the youngest of each age are carried over to the next block, so memory doesn't follow a text's length.
Each extension emits the bucket of the feature that it ends.

A bucket's gain compares its share in the target with its share in the documents; a document's weight is the sum over its
features.  Adding Gumbel noise from a hash of the id and taking the highest scores draws without replacement in proportion to
exp(weight).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

BLOCK_WORDS = 1 << 16
#: Lower-cases A-Z; of the other ASCII characters digits and letters stay, the rest turn into blanks.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def ring(found: list[bytes], n: int = 3) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to ``n`` consecutive words joined by a space, by the block."""
    carried: list[list[int]] = [[] for _ in range(n - 1)]
    for at in range(0, len(found), BLOCK_WORDS):
        block = found[at : at + BLOCK_WORDS]
        more = [b" " + w for w in block]
        states = [*map(crc32, block)]
        yield np.array(states, dtype=np.uint32)
        for age in range(n - 1):
            states = carried[age] + states
            carried[age] = states[-1:]
            extended = len(states) - 1
            states = [*map(crc32, more[len(more) - extended :], states)]
            yield np.array(states, dtype=np.uint32)


def bucket_counts(docs: DataFrame, n: int = 3, n_buckets: int = 10_000) -> DataFrame:
    """bucket and how often the features of all texts fall there; buckets without any are absent."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                for states in ring(words(text.as_py()), n):
                    total += np.bincount(states % n_buckets, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return in_arrow(docs.select(F.col("text").cast("binary")), of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 3, n_buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each of the B buckets; only these B numbers come to the driver."""

    def counted(df: DataFrame) -> list[float]:
        out = [0.0] * n_buckets
        for r in bucket_counts(df, n, n_buckets).collect():
            out[r["bucket"]] = float(r["n"])
        return out

    s, t = counted(docs), counted(target)
    all_s, all_t = sum(s) + n_buckets, sum(t) + n_buckets
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, n: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros((3, b.num_rows), dtype=np.int64)
            for i, text in enumerate(b.column(1)):
                found = words(text.as_py())
                rows[0, i] = len(found)
                for states in ring(found, n):
                    rows[1:, i] += len(states), gain[states % len(gain)].sum()
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, rows)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", F.col("text").cast("binary")), of, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, n_buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where it isn't drawn.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn, the highest scores first, ties to the
    smaller doc_id; rows of one doc_id and one score (repeated rows) take their ranks in any order.  Null and wordless texts
    have no features and weight 0.  A null doc_id has a null score and is never drawn, nor counted in N; its features are
    counted.  Empty target: its counts are zero.  No rows: no rows out.

    Ranks are places in a range-sorted order: rows ahead in the partitions before, then the place in its own.
    """
    rows = cut(weighted(docs, gains(docs, target, n, n_buckets), n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.coalesce(F.col("score").isNotNull() & (F.col("n_words") >= least_words), F.lit(False))
    keys = [F.desc("_able"), F.desc("score"), F.asc("doc_id")]
    # the place in the sorted partitions is part of what is written: partition above, row below
    placed = cut(rows.withColumn("_able", able).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes, ahead, all_of = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_able").alias("able")).collect(), {}, 0
    for r in sorted(sizes):  # a row for each partition
        ahead[r["part"]], all_of = all_of, all_of + r["n"]
    drawn = percent * sum(r["able"] for r in sizes) // 100
    starts = placed.sparkSession.createDataFrame([*ahead.items()], "part long, ahead long")
    rank = F.col("ahead") + place + 1
    out = placed.join(F.broadcast(starts), part == F.col("part"))
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_able") & (rank <= drawn), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; all rows of a drawn doc_id come along."""
    ids = importance(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["_drawn"], "left_semi")

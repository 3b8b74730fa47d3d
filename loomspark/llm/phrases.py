"""Phrase collocations by level-wise Apriori passes.

Pass k reads the texts once.  The phrases of k-1 words that are frequent go out to all tasks, and a phrase of k words is emitted
only where both its parts of k-1 words are among them; occurrences are added up in the task first, then by a shuffle.  Each
level's table of frequent phrases is written to the shared folder; scores and drops are joins of these tables.

What goes out is bounded: up to SET_PHRASES phrases of SET_BYTES together as a set, beyond that a Bloom filter of PHRASE_BITS a
phrase, FILTER_BITS at most.  Phrases that the filter lets through by mistake are counted and then found to be infrequent, so
the result is the same.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow

SET_PHRASES = 1 << 17
SET_BYTES = 1 << 23
PHRASE_BITS = 16
FILTER_BITS = 1 << 28
FILTER_HASHES = 3
#: So many different phrases are added up before a task hands them on.
HELD = 1 << 18
#: Shares of a language's candidates whose best are found apart.
SHARES = 64
UND = "und"
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


def words(text: bytes | None) -> list[bytes]:
    """Words of all pieces, a full stop (which no word holds) between two pieces."""
    return (text or b"").lower().translate(_ENDS).replace(b".", b" . ").split()


def phrases(found: list[bytes], k: int, frequent) -> list[bytes]:
    """The phrases of k words whose parts of k-1 words are frequent; of single words, all."""
    if k == 1:
        return [w for w in found if w != b"."]
    part = found
    for i in range(1, k - 1):
        part = [a + b" " + b for a, b in zip(part, found[i:])]
    good = frequent.has(part)
    return [a + b" " + b for a, b, x, y in zip(part, found[k - 1 :], good, good[1:]) if x and y]


class Bloom:
    """Membership of (lang, phrase) in a table of bits; one that was put in is never missed."""

    def __init__(self, bits: np.ndarray, seed: int = 42):
        self.bits, self.seed = bits, seed

    def of(self, lang: str) -> Bloom:
        return Bloom(self.bits, xxhash.xxh64_intdigest(lang.encode(), 42))

    def has(self, phrases_: list[bytes]) -> list[bool]:
        h = np.fromiter(map(xxhash.xxh64_intdigest, phrases_, repeat(self.seed)), np.uint64, len(phrases_))
        out = np.ones(len(h), dtype=bool)
        for i in range(FILTER_HASHES):
            p = h >> np.uint64(17 * i) & np.uint64(64 * len(self.bits) - 1)
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out.tolist()


class Phrases:
    """The same as sets."""

    def __init__(self, langs: list[str], phrases_: list[bytes]):
        self.sets = defaultdict(set)
        for lang, p in zip(langs, phrases_, strict=True):
            self.sets[lang].add(p)

    def of(self, lang: str) -> Phrases:
        out = Phrases([], [])
        out.own = self.sets.get(lang, set())
        return out

    def has(self, phrases_: list[bytes]) -> list[bool]:
        return [*map(self.own.__contains__, phrases_)]


def bloom(frequent: DataFrame, n: int) -> Bloom:
    """Bits are put together in the cluster, by words of 64; at most FILTER_BITS / 64 words come to the driver."""
    size = min(FILTER_BITS, 1 << max(12, (PHRASE_BITS * n).bit_length()))
    h = F.xxhash64("lang", "phrase")  # the hash of lang is the seed for the phrase
    place = F.explode(F.array(*(F.shiftrightunsigned(h, 17 * i).bitwiseAND(F.lit(size - 1)) for i in range(FILTER_HASHES)))).alias("p")
    rows = frequent.select(place).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).toArrow()  # columns, not rows
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bloom(bits)


def sent(frequent: DataFrame, most: int, most_bytes: int) -> Broadcast:
    size = frequent.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("bytes")).first()
    if size["n"] > most or size["bytes"] > most_bytes:
        return frequent.sparkSession.sparkContext.broadcast(bloom(frequent, size["n"]))
    rows = frequent.select("lang", "phrase").toArrow()
    return frequent.sparkSession.sparkContext.broadcast(Phrases(rows["lang"].to_pylist(), rows["phrase"].to_pylist()))


def counted(docs: DataFrame, k: int, frequent: Broadcast | None) -> DataFrame:
    """lang, phrase (bytes) and n of the phrases of k words, as far as their parts are frequent."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            size = [len(c) for c in counts.values()]
            out = [pa.array(np.repeat(np.array([*counts], dtype=object), size), pa.string()), pa.array([p for c in counts.values() for p in c], pa.binary()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(out, ["lang", "phrase", "n"])

        counts: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts[lang].update(phrases(words(text.as_py()), k, frequent and frequent.value.of(lang)))
                if sum(map(len, counts.values())) >= HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    return in_arrow(docs, of, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def part(first: int, last: int) -> F.Column:
    """Words ``first`` to before ``last`` of the array w."""
    return F.encode(F.array_join(F.slice("w", first + 1, last - first), " "), "utf-8")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, absorb: int = 50, most: int = SET_PHRASES, most_bytes: int = SET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of 2 to ``longest`` words.

    a, l and r are the counts of the phrase and of the parts of its worst cut, n all words of the language.  Phrases with fewer
    than ``least`` occurrences don't count; one that lies in a longer one with ``absorb`` percent of its occurrences goes.  Null
    lang: und, together with documents whose lang says so.  Null, empty and wordless texts have no phrases; repeated rows count
    each time; no phrases: no rows.  Phrases are compared by their bytes.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), F.col("text").cast("binary")).where("text IS NOT NULL")
    single = cut(counted(texts, 1, None))
    all_words = single.groupBy("lang").agg(F.sum("n").alias("n_words"))
    levels = [single.where(F.col("n") >= least)]
    for k in range(2, longest + 1):
        levels.append(cut(counted(texts, k, sent(levels[-1], most, most_bytes)).where(F.col("n") >= least)))

    scored = []
    for k in range(2, longest + 1):
        rows = levels[k - 1].select("lang", "phrase", F.col("n").alias("a"), F.split(F.decode("phrase", "utf-8"), " ").alias("w"))
        for c in range(1, k):
            l, r = levels[c - 1], levels[k - c - 1]
            rows = rows.withColumn("_l", part(0, c)).withColumn("_r", part(c, k))
            rows = rows.join(l.select("lang", F.col("phrase").alias("_l"), F.col("n").alias(f"l{c}")), ["lang", "_l"]).join(r.select("lang", F.col("phrase").alias("_r"), F.col("n").alias(f"r{c}")), ["lang", "_r"]).drop("_l", "_r")
        wide = "CAST({} AS DECIMAL(15,0))".format  # counts below 10^15: the products fit 38 digits
        cuts = [F.struct(F.expr(f"1000000 * {wide('a')} * {wide('a')} div ({wide(f'l{c}')} * {wide(f'r{c}')})").alias("score"), F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        scored.append(rows.select("lang", "phrase", "a", (F.array_min(F.array(*cuts)) if k > 2 else cuts[0]).alias("worst")))
    candidates = scored[0]
    for more in scored[1:]:
        candidates = candidates.unionByName(more)

    inner = None
    for k in range(3, longest + 1):
        longer = levels[k - 1].select("lang", F.col("n").alias("f"), F.split(F.decode("phrase", "utf-8"), " ").alias("w"))
        inside = longer.select("lang", "f", F.explode(F.array(*(part(i, j) for i in range(k) for j in range(i + 2, k + 1) if j - i < k))).alias("phrase"))
        inner = inside if inner is None else inner.unionByName(inside)
    if inner is not None:
        inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
        candidates = candidates.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("f") >= absorb * F.col("a"), F.lit(False)))

    best = [F.desc(F.col("worst.score")), F.desc("a"), F.asc("phrase")]
    share = candidates.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = share.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*best))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    out = ranked.join(all_words, "lang")
    return out.select("lang", "rank", F.decode("phrase", "utf-8").alias("phrase"), "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), F.col("n_words").alias("n"), F.col("worst.score").alias("score"))

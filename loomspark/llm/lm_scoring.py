"""Language-model scores: prediction by partial matching with symbol exclusion, beside a word model with added counts.

The trie.  For contexts of ORDER bytes down to none it holds how often each byte followed.  A byte is coded in the longest context
that was seen: with probability n / (T + d), n being the byte's count, T the context's and d its number of different bytes; else
an escape, d / (T + d), leads to the context that is a byte shorter, where all bytes of the longer one are excluded from n's
rivals, from T and from d.  A context whose bytes are all excluded is passed without cost; under none, the bytes not excluded
are equally likely.  What follows a context also follows its suffixes, so the bytes excluded are always those of one context, and
the sums left after exclusion are two numbers for each context.

A text is its UTF-8 bytes, A-Z in lower case, between ends: ORDER bytes 0xFF before, which UTF-8 never holds, and one behind,
which is coded like any byte.  Pretrained scores use statistics frozen over all texts that are learnt from; adaptive scores start
from nothing and learn from each byte after coding it.

How the model travels.  Grams of up to SHORT + 1 bytes are at most 2^24, whatever the corpus, and go to every task.  Longer ones
go out in slices: all contexts that end in the same SHORT + 1 bytes lie in one slice, and slices are filled with such groups up
to SLICE_GRAMS.  One slice is the rule; if there are more, each is a pass over the texts that codes the bytes whose context is in
it, and a text's parts are added up.  Words: the HOT_WORDS most frequent go out as a table, the others of each text meet their
counts by a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, row_id, shared_folder

ORDER = 4
#: Contexts of so many bytes or fewer belong to all slices.
SHORT = 2
END = b"\xff"
#: Grams of SHORT + 1 bytes.
ALL = 1 << 8 * (SHORT + 1)
SLICE_GRAMS = 1 << 22
SLICE_BYTES = 2 << 20
HOT_WORDS = 1 << 17
#: A word longer than this is known by its digest, behind a space, which no word holds.
LONG_WORD = 32


def tokens(text: bytes | None) -> Counter:
    """How often each word occurs in a lower-cased text; the end, once, is the empty word."""
    found = Counter((text or b"").lower().split())
    for w in [w for w in found if len(w) > LONG_WORD]:
        found[b" " + sha256(w).digest()] = found.pop(w)
    found[b""] = 1
    return found


def runs(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By the slice: for each coded byte itself behind its context, in one number, and the number of its text."""

    def made(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p for _, p in parts), dtype=np.uint8).astype(np.int64)
        key = data.copy()
        for back in range(1, ORDER + 1):
            key[back:] |= data[:-back] << (8 * back)
        size = np.array([len(p) for _, p in parts])
        own = np.ones(len(data), dtype=bool)
        starts = np.cumsum(size) - size
        for back in range(ORDER):  # what is only context
            own[starts + back] = False
        return key[own], np.repeat([i for i, _ in parts], size - ORDER)

    parts: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        whole = END * ORDER + (text or b"").lower() + END
        for at in range(0, len(whole) - ORDER, SLICE_BYTES):
            parts.append((i, whole[at : at + SLICE_BYTES + ORDER]))
            held += len(parts[-1][1])
            if held >= SLICE_BYTES:
                yield made(parts)
                parts, held = [], 0
    if parts:
        yield made(parts)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, at = np.unique(keys, return_inverse=True)
    return out, np.bincount(at, weights=n, minlength=len(out)).astype(np.int64)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """Grams of one length: counts, contexts with T and d, and of the next shorter context what exclusion leaves of T and d."""

    def __init__(self, order: int, gram: np.ndarray, n: np.ndarray, below: Level | None):
        self.order, self.gram, self.n = order, gram, n
        self.context, at = np.unique(gram >> 8, return_inverse=True)
        size = len(self.context)
        self.total, self.different = np.bincount(at, weights=n, minlength=size), np.bincount(at, minlength=size).astype(float)
        if below is not None:
            excluded = np.bincount(at, weights=below.n[found(below.gram, gram & ((1 << 8 * order) - 1))[0]] if size else None, minlength=size)
            suffix = found(below.context, self.context & ((1 << 8 * (order - 1)) - 1))[0]
            self.left_total, self.left_different = (below.total[suffix] - excluded, below.different[suffix] - self.different) if size else (self.total, self.different)


class Trie:
    """All contexts of SHORT bytes or fewer, and the longer ones whose last SHORT + 1 bytes are from ``low`` to below ``high``."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray, low: int = 0, high: int = ALL):
        self.low, self.high, self.levels, below = low, high, [], None
        for order in range(ORDER + 1):
            some, times = (short, short_n) if order <= SHORT else (gram, n)
            below = Level(order, *summed(some & ((1 << 8 * (order + 1)) - 1), times), below)
            self.levels.append(below)
        top = below
        gram, n = top.gram, top.n
        at = found(top.context, gram >> 8)[0]
        self.cost = np.log10(n / (top.total[at] + top.different[at])) if len(gram) else np.zeros(0)
        # places of grams by a multiplicative hash, in four times the room or more; those that lose their slot go the long way
        self.shift = np.uint64(64 - max(4, (4 * len(gram)).bit_length()))
        self.place = np.zeros(1 << int(64 - self.shift), dtype=np.int32)
        self.place[self.slot(gram)] = np.arange(len(gram))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram behind the others."""
        gram = self.levels[-1].gram
        if not len(gram):
            return self._long_way(key)
        at = self.place[self.slot(key)]
        out = self.cost[at]
        rest = np.flatnonzero(gram[at] != key)
        if len(rest):
            out[rest] = self._long_way(key[rest])
        return out

    def _long_way(self, key: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(key)), np.arange(len(key))
        left, left_d, above = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key), dtype=bool)
        for level in reversed(self.levels):
            part = key[live] & ((1 << 8 * (level.order + 1)) - 1)
            at, seen = found(level.context, part >> 8)
            if not len(level.context):
                continue
            total, different = np.where(above[live], left[live], level.total[at]), np.where(above[live], left_d[live], level.different[at])
            gram, known = found(level.gram, part)
            usable = seen & (different > 0)
            hit, escape = usable & known, usable & ~known
            out[live[hit]] += np.log10(level.n[gram[hit]] / (total[hit] + different[hit]))
            out[live[escape]] += np.log10(different[escape] / (total[escape] + different[escape]))
            if level.order:
                left[live[seen]], left_d[live[seen]] = level.left_total[at[seen]], level.left_different[at[seen]]
            above[live[seen]] = True
            live = live[~hit]
        known_bytes = self.levels[0].different.sum()
        out[live] -= np.log10(max(1.0, 256 - known_bytes))
        return out

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """log10 probability of each text, as far as its contexts are of this slice."""
        out = np.zeros(len(texts))
        for key, of in runs(texts):
            if (self.low, self.high) != (0, ALL):
                end = (key >> 8) % ALL
                mine = (end >= self.low) & (end < self.high)
                key, of = key[mine], of[mine]
            out += np.bincount(of, weights=self.log10(key), minlength=len(texts))
        return out


def adaptive_score(text: bytes | None) -> float:
    """log10 probability of a text under a trie that learns from it, each byte after it was coded."""
    seen: dict[bytes, Counter] = {}
    before, out = END * ORDER, 0.0
    for b in (text or b"").lower() + END:
        excluded: Counter = Counter()
        for order in range(ORDER, -1, -1):
            after = seen.get(before[ORDER - order :])
            if after is None:
                continue
            rivals = {x: n for x, n in after.items() if x not in excluded}
            if rivals:
                weight = sum(rivals.values()) + len(rivals)
                out += math.log10(rivals.get(b, len(rivals)) / weight)
                if b in rivals:
                    break
            excluded = after
        else:
            out -= math.log10(256 - len(excluded))
        for order in range(ORDER + 1):
            seen.setdefault(before[ORDER - order :], Counter())[b] += 1
        before = before[1:] + bytes([b])
    return out


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def statistics(docs: DataFrame) -> DataFrame:
    """word or gram, the other null, and n, over all texts: one scan, one shuffle of what each task has counted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: Counter, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            a, b = len(words), len(gram)
            return pa.RecordBatch.from_arrays([pa.array([*words, *[None] * b], pa.binary()), pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(gram)]), pa.array(np.concatenate([np.fromiter(words.values(), np.int64, a), n]))], ["word", "gram", "n"])

        words: Counter = Counter()
        gram = n = np.zeros(0, dtype=np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for t in texts:
                words.update(tokens(t))
                if len(words) >= 1 << 19:
                    yield rows(words, gram[:0], n[:0])
                    words = Counter()
            for key, _ in runs(texts):
                more, times = np.unique(key, return_counts=True)
                gram, n = summed(np.concatenate([gram, more]), np.concatenate([n, times]))
                if len(gram) >= 1 << 21:
                    yield rows(Counter(), gram, n)
                    gram, n = gram[:0], n[:0]
        yield rows(words, gram, n)

    return in_arrow(docs.select(F.col("text").cast("binary")), of, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


class Model:
    """What was learnt: tables of words and grams in the shared folder, and the few sums that all texts need."""

    def __init__(self, docs: DataFrame, add: float = 0.1, slice_grams: int = SLICE_GRAMS, hot_words: int = HOT_WORDS):
        both = cut(statistics(docs))
        self.words, self.grams = both.where("word IS NOT NULL").select("word", "n"), both.where("gram IS NOT NULL").select("gram", "n")
        r = self.words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.add, self.of = r["n"], add, r["n"] + add * (r["v"] + 1)
        # the most frequent words, by sixteenths of a power of two: as many whole steps from the top as hot_words allows
        steps, room, least = self.words.groupBy(self._step().alias("step")).agg(F.count("*").alias("n")).collect(), hot_words, math.inf
        for r in sorted(steps, reverse=True):
            room -= r["n"]
            if room < 0:
                break
            least = r["step"]
        hot = self.words.where(self._step() >= F.lit(float(least))).toArrow()  # columns, not rows
        self.hot = dict(zip(hot["word"].to_pylist(), hot["n"].to_pylist(), strict=True))
        self.short = self.grams.groupBy((F.col("gram") % ALL).alias("gram")).agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
        self.cuts, held = [0], 0
        sizes = self.grams.groupBy(self._end().alias("end")).agg(F.count("*").alias("n")).orderBy("end").toArrow()  # at most 2^24
        for end, size in zip(sizes["end"].to_pylist(), sizes["n"].to_pylist(), strict=True):
            if held and held + size > slice_grams:
                self.cuts.append(end)
                held = 0
            held += size
        self.cuts.append(ALL)

    @staticmethod
    def _step() -> Column:
        return F.floor(16 * F.log2("n"))

    @staticmethod
    def _end() -> Column:
        """Last bytes of a gram's context."""
        return F.shiftright("gram", 8) % ALL

    def tries(self) -> Iterator[Trie]:
        for low, high in zip(self.cuts, self.cuts[1:]):
            part = self.grams.where(self._end().between(low, high - 1)).orderBy("gram").toArrow()
            yield Trie(part["gram"].to_numpy(), part["n"].to_numpy(), self.short["gram"].to_numpy(), self.short["n"].to_numpy(), low, high)


def score(docs: DataFrame, model: Model, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null texts count as empty: the end is their only token, the end byte all that is coded.  Null doc_id: not held out.  Repeated
    rows each get a row.  Nothing learnt: no known token, and 8 bits a byte; base_score is then that of one unknown token among one.
    No rows: no rows out.
    """
    spark, add, of = docs.sparkSession, model.add, model.of
    rows = docs.select(row_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    if len(model.cuts) > 2:  # several passes must number rows alike
        folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        rows = spark.read.parquet(folder)
    unknown, hot = math.log10(add / of), spark.sparkContext.broadcast({w: math.log10((n + add) / of) for w, n in model.hot.items()})

    def first(trie):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "times"]
            cost_of = hot.value
            for b in batches:
                texts, ids = b.column(2).to_pylist(), b.column(0).to_pylist()
                n_tokens, n_known, base = [], [], []
                rare: tuple[list, list, list] = ([], [], [])
                for i, t in zip(ids, texts, strict=True):
                    own, known, sum_of = tokens(t), 0, 0.0
                    for w, k in own.items():
                        cost = cost_of.get(w)
                        if cost is not None:
                            known += k
                            sum_of += k * cost
                        else:
                            rare[0].append(i)
                            rare[1].append(w)
                            rare[2].append(k)
                    n_tokens.append(own.total())
                    n_known.append(known)
                    base.append(sum_of)
                none = lambda kind: pa.nulls(len(rare[0]), kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n_tokens, n_known)), pa.array(base, pa.float64()), pa.array(trie.value.score(texts)), pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.int64())], names)
                if rare[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(rare[0], pa.int64()), none(b.schema.field(1).type), *map(none, (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(rare[1], pa.binary()), pa.array(rare[2], pa.int64())], names)

        return of

    def further(trie):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trie.value.score(b.column(2).to_pylist()))], ["row", "score"])

        return of

    kind = docs.schema["doc_id"].dataType.simpleString()
    tries = [spark.sparkContext.broadcast(t) for t in model.tries()]
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    in_arrow(rows, first(tries[0]), f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, word binary, times long").write.parquet(folder)
    made = spark.read.parquet(folder)
    out = made.where("word IS NULL").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    rest = made.where("word IS NOT NULL").select("row", "word", "times").join(model.words, "word", "left")
    cost = F.col("times") * F.coalesce(F.log10((F.col("n") + add) / of), F.lit(unknown))
    parts = [rest.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"), F.sum(cost).alias("base")).withColumn("score", F.lit(0.0))]
    parts += [in_arrow(rows.select("row", "doc_id", "text"), further(t), "row long, score double").select("row", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), "score") for t in tries[1:]]
    more = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("n_known", "base", "score")))
    plus = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return out.join(more, "row", "left").select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens", plus("n_known").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"))


def adaptive(docs: DataFrame) -> DataFrame:
    """doc_id and adaptive score of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([adaptive_score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return in_arrow(docs.select("doc_id", F.col("text").cast("binary")), of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def train(docs: DataFrame, folds: int = 10, **options) -> Model:
    """From all documents that aren't held out."""
    return Model(docs.where(~held_out(F.col("doc_id"), folds)), **options)

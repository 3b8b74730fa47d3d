"""Best-fit packing of token pieces by the linear grouping scheme.

Only the histogram of lengths, with at most ``capacity`` bars however large the corpus, comes to the driver; there it is
packed, and the packing is described by bin types: so many sequences, each with so many pieces of each length.

Large lengths are dealt, in falling order, into groups of equal cardinality and rounded up to the longest of their group.  For
the few sizes left, sequences are filled by configurations: the linear program over all configurations is solved by column
generation (an unbounded knapsack prices the next), and rounded down.  Actual pieces then take the slots of their group, the
longest first, which leaves room; all pieces without a slot, large and small, go by best fit in falling order.

A piece finds its place by its rank among the pieces of its length: a counter within its partition, plus the pieces of that
length in the partitions before.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, byte_letters
from .common import cut, in_pandas

CAPACITY = 1024
END_ID = 2
#: Groups of large lengths with the share of the capacity from which a length is large; the settings are all tried.
SETTINGS = ((320, 0.4), (160, 0.2))

#: Sequences of one kind: how many, and their (length, pieces) pairs.
BinType = tuple[int, tuple[tuple[int, int], ...]]


def price(rest: np.ndarray, values: np.ndarray) -> tuple[float, np.ndarray]:
    """Most value that fits a sequence, and the number of each size in it.

    rest: for each size and room the room that is left, -1 where it doesn't fit; pieces are added one by one.
    """
    n, rooms = rest.shape
    best, chosen = np.zeros(rooms), []
    while True:
        got = np.where(rest >= 0, best[rest] + values[:, None], -1.0)
        pick = got.argmax(axis=0)
        more = got[pick, np.arange(rooms)]
        if not (more > best + 1e-12).any():
            break
        chosen.append(np.where(more > best + 1e-12, pick, -1))
        best = np.maximum(best, more)
    out, room = np.zeros(n, dtype=np.int64), rooms - 1
    for layer in reversed(chosen):
        if layer[room] >= 0:
            out[layer[room]] += 1
            room = rest[layer[room], room]
    return float(best[-1]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of sequences by configuration, from the linear program rounded down."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    x = np.linalg.solve(basis, need)
    rest = np.maximum(np.arange(capacity + 1)[None, :] - np.array(sizes)[:, None], -1)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(n))
        worth, column = price(rest, np.maximum(dual, 0))
        if worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out], basis[:, out] = ratio[out], column
    return [(int(k), basis[:, j].astype(np.int64)) for j, k in enumerate(np.floor(x + 1e-9)) if k > 0]


def _filled(bins: list[tuple[int, np.ndarray]], groups: list[list[list[int]]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Configurations with actual lengths in their slots.  groups: for each size [length, count] runs, longest first; used up here."""
    out = []
    for count, slots in sorted(bins, key=lambda b: -int(b[1].sum())):
        while count:
            # as many sequences as go on with the same runs in all slots
            taken, same = [], count
            for g, m in enumerate(slots):
                m = int(m)
                if not m:
                    continue
                runs = [r for r in groups[g] if r[1]]
                if not runs:
                    continue
                if runs[0][1] >= m:
                    taken.append((runs[0], m))
                    same = min(same, runs[0][1] // m)
                else:  # one sequence across the end of a run
                    same = 1
                    for r in runs:
                        k = min(m, r[1])
                        taken.append((r, k))
                        m -= k
                        if not m:
                            break
            if not taken:
                break
            for r, k in taken:
                r[1] -= k * same
            out.append((same, [(r[0], k) for r, k in taken]))
            count -= same
    return out


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[BinType]:
    """Bin types that hold every piece of ``histogram`` (length: count), of the setting that needs the fewest sequences."""
    return min((grouped(histogram, capacity, *s) for s in SETTINGS), key=lambda bins: sum(count for count, _ in bins))


def grouped(histogram: dict[int, int], capacity: int, n_groups: int, from_share: float) -> list[BinType]:
    bins: list[BinType] = []
    left = {n: c for n, c in histogram.items() if c > 0}
    large = [[n, c] for n, c in sorted(left.items(), reverse=True) if n >= capacity * from_share]
    total = sum(c for _, c in large)
    opened: list[tuple[int, list[tuple[int, int]]]] = []
    if total:
        share = -(-total // n_groups)
        groups: list[list[list[int]]] = [[]]
        room = share
        for n, c in large:
            while c:
                k = min(c, room)
                groups[-1].append([n, k])
                c, room = c - k, room - k
                if not room:
                    groups.append([])
                    room = share
        groups = [g for g in groups if g] if len(large) > n_groups else [[r] for r in large]  # few lengths need no rounding
        # groups that round up to one length are one size
        merged: dict[int, list[list[int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        opened = _filled(configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity), [merged[s] for s in sizes])
        for n in {r[0] for g in merged.values() for r in g}:
            left[n] = sum(r[1] for g in merged.values() for r in g if r[0] == n)
    # Best fit, by room: equal sequences are counted together.
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(count: int, holds: list[tuple[int, int]]) -> None:
        room = capacity - sum(n * k for n, k in holds)
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append([count, holds])

    for count, holds in opened:
        put(count, holds)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                k = capacity // n
                if c >= k:
                    put(c // k, [(n, k)])
                    c %= k
                else:
                    put(1, [(n, c)])
                    c = 0
                continue
            room = order[at]
            kind = rooms[room][-1]
            k = min(room // n, c)
            many = min(kind[0], c // k)
            kind[0] -= many
            if not kind[0]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            put(many, [*kind[1], (n, k)])
            c -= many * k
    for kinds in rooms.values():
        for count, holds in kinds:
            one: Counter[int] = Counter()
            for n, k in holds:
                one[n] += k
            bins.append((count, tuple(sorted(one.items(), reverse=True))))
    return bins


def places(bins: list[BinType]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces a sequence, first sequence, first offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter[int] = Counter()
    base = 0
    for count, holds in bins:
        offset = 0
        for n, k in holds:
            out.setdefault(n, []).append((rank[n], k, base, offset))
            rank[n] += count * k
            offset += n * k
        base += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


@lru_cache(maxsize=4)
def byte_tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level tokenizer of a vocabulary file, its special strings included; once for each Python worker.

    The file lists tokens in the order of their merges, so ids serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    #: Fixed value: the splitting pattern of byte-level vocabularies.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


#: A run of so many blanks is too long for the splitting pattern, whose matcher steps back over it.
LONG_RUN = 100_000
_RUN = regex.compile(f"[{SPACE}]{{2,}}+")  # the least length isn't part of it: compiled, a run of that many takes 67 MB in every worker


def _long_runs(text: str) -> Iterator[regex.Match]:
    return (m for m in _RUN.finditer(text) if m.end() - m.start() >= LONG_RUN)


def encode_whole(t: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text of any length.

    A long run of blanks is a piece by itself, but for its last blank if something follows: that one belongs to the next piece.
    """
    if len(text) < LONG_RUN or next(_long_runs(text), None) is None:
        return t.encode(text, allowed_special="all")
    out: list[int] = []
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(t.special_tokens_set, key=len, reverse=True))) + ")") if t.special_tokens_set else None
    for part in special.split(text) if special else [text]:
        at = 0
        for run in _long_runs(part):
            end = run.end() - (run.end() < len(part))
            out += t.encode(part[at : run.start()], allowed_special="all")
            out += t._encode_single_piece(part[run.start() : end])
            at = end
        out += t.encode(part[at:], allowed_special="all")
    return out


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: all but the first are full."""
    return [0, *range(n % capacity or capacity, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, with the partition and a counter among its pieces of that length."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, part, seen = byte_tokenizer(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode_whole(t, text or ""), end_id], dtype="<u4")
                for i, a in enumerate(cut_points(len(ids), capacity)):
                    one = ids[a : a + capacity] if i else ids[: len(ids) % capacity or capacity]
                    rows.append((doc_id, i, a, len(one), zlib.crc32(one.tobytes()), part, seen[len(one)]))
                    seen[len(one)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return in_pandas(docs.select("doc_id", "text"), of, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Null and empty texts are a piece of the end id alone.  Null and repeated doc_id: every row stands for itself.  No rows: no
    rows out.  Other columns are not read.
    """
    rows = cut(pieces(docs, path, capacity, end_id))
    counts = cut(rows.groupBy("part", "length").agg(F.count("*").alias("c")))
    bars = counts.groupBy("length").agg(F.sum("c").alias("c")).collect()  # a row for each length, ``capacity`` at most
    plan = places(pack({r["length"]: r["c"] for r in bars}, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(counts.select("part", "length", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base")), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                run = plan[int(n)]
                run = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                k = rank[at] - run[:, 0]
                sequence[at], offset[at] = run[:, 2] + k // run[:, 1], run[:, 3] + k % run[:, 1] * n
            yield b.assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, sequence_id long, offset long"
    return in_pandas(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), of, schema).drop("rank")

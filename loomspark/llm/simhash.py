"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into three segments of at most 23 bits, words of the perfect [23,12,7] Golay code.  Two
fingerprints at two differing bits or fewer agree in one whole segment (pigeonhole), and in the next segment they differ in
two bits at most.  Take the word halfway between two such segments: the codeword nearest to it is at most three bits away,
so at most four from either.  Hence the keys of a fingerprint: for each segment, its exact value with the 12-bit index of
every codeword within four bits of the next segment (one or six of them).  Fingerprints that share a key are compared, and
linked at two differing bits or fewer.  All of this is on distinct fingerprints; copies only count.

Components come from alternating star contraction over the links, with the rows of each round written to the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_pandas
from .components import components

#: First bit and length of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: the generator polynomial of the [23,12,7] Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
MAX_BITS = 2


def _syndrome(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


def _errors() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of at most four bits that have it, -1 where there are fewer than six."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], dtype=np.int64)
    out, n = np.full((2048, 6), -1, dtype=np.int64), np.zeros(2048, dtype=int)
    for p, s in zip(patterns, _syndrome(patterns), strict=True):
        out[s, n[s]] = p
        n[s] += 1
    return out


ERRORS = _errors()


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within four bits of each 23-bit word, six columns, -1 where there are fewer."""
    e = ERRORS[_syndrome(words)]
    return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of uint64 fingerprints: rows (positions in ``prints``) and their int64 keys."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, out = [], []
    for s in range(3):
        near = golay_indices(parts[(s + 1) % 3])
        for j in range(near.shape[1]):
            has = np.flatnonzero(near[:, j] >= 0)
            rows.append(has)
            out.append((s << 60) | (near[has, j] << 24) | parts[s][has])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """64 bits: one is set if it is set in over half of the XXH64 hashes of the text's ``k``-word shingles.

    A-Z count as a-z.  Fewer words than ``k``: the whole sequence is the one shingle; no word: zero.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only the six ASCII blanks
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < k else map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    set_in = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        set_in += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every document."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([fingerprint(t, k) for t in b["text"]], dtype=np.uint64).view(np.int64)})

    return in_pandas(docs.select("doc_id", "text"), of, "doc_id long, fp long")


def keyed(distinct: DataFrame) -> DataFrame:
    """A row for each key of each distinct fingerprint."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            rows, key = keys(fp.view(np.uint64))
            yield pd.DataFrame({"key": key, "fp": fp[rows]})

    return in_pandas(distinct.select("fp"), of, "key long, fp long")


#: Distinct fingerprints under one key beyond which the key is split by the codeword indices of the third segment.
LARGE_KEY = 2048


def finer(prints: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys that split a key: whoever is linked under it also shares an index of the remaining segment."""
    parts = np.stack([((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS])
    third = parts[(key >> 60) + 2 - 3 * ((key >> 60) > 0), np.arange(len(key))]
    near = golay_indices(third)
    rows, out = [], []
    for j in range(near.shape[1]):
        has = np.flatnonzero(near[:, j] >= 0)
        rows.append(has)
        out.append(near[has, j])
    return np.concatenate(rows), np.concatenate(out)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs u < v of distinct fingerprints (column fp) at MAX_BITS or fewer differing bits."""
    rows = cut(keyed(distinct))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(rows.join(sizes, "key").withColumn("sub", F.lit(0).cast("long")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, sub = finer(b["fp"].to_numpy().view(np.uint64), b["key"].to_numpy())
            yield pd.DataFrame({"key": b["key"].to_numpy()[at], "fp": b["fp"].to_numpy()[at], "sub": sub})

    rows = rows.where(F.col("n") <= LARGE_KEY).select("key", "fp", "sub").unionByName(in_pandas(rows.where(F.col("n") > LARGE_KEY).select("key", "fp"), split, "key long, fp long, sub long"))
    a, b = rows.select("key", "sub", F.col("fp").alias("u")), rows.select("key", "sub", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    return a.join(b, ["key", "sub"]).where(near).select("u", "v").distinct()


def near_groups(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links lead to, of every document.

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Null doc_id: the row takes part, but
    never names a component unless no row of it has an id.  Repeated rows each stay.  No rows: no rows out.
    """
    prints = cut(fingerprints(docs, k))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_print(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near-duplicate texts: longer fingerprints, for similarities at which 64 bits differ in more than a few.

#: 64-bit words of a long fingerprint.  The first sorts out pairs; the others hold PAIRS pairs of segments.
WORDS, PAIRS = 7, 8
#: Texts at this Jaccard similarity of their sets of shingles, or above, are copies.
SIMILAR = 0.8
#: Differing bits of the first word, of the first and another that has no part in the key, and of all, beyond which a pair isn't
#: compared.  Simulated at similarity 0.8 on 4 to 400 shingles: 61 to 84 of all bits differ on average, 113 at most; what is
#: nearer is decided by SIMILAR.  Two words, since one alone lets one in 120 chance meetings pass, and these grow with the square.
FIRST_BITS, TWO_BITS, ALL_BITS = 22, 40, 112
#: Rows under one key beyond which they meet in pairs of chunks; of so many rows or fewer under a key every pair is a candidate
#: at once; in larger ones each row is first linked to the NEAREST few, under the keys of its nearest codewords only, and then
#: to all that these links left apart (so are pairs of such names under small keys).
LARGE_BUCKET, SMALL_BUCKET, NEAREST = 20_000, 8, 2
#: Fingerprints of a partition up to which its keys, 36 each at most for a pair of segments, are counted by sorting them.
FEW_PRINTS = 1 << 14
#: Comparisons that a task holds at a time.
AT_ONCE = 1 << 20
#: Counts by which shingles are put in order.
SHINGLE_BUCKETS = 1 << 18
_EXPAND = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(WORDS)], dtype=np.uint64)


def shingle_set(body: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's ``k``-word shingles; ``body`` has the words with single blanks between them."""
    w = body.split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    shingles = [body] if len(w) < k else map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits of a set of hashes, by the same rule as ``fingerprint``, each over other bits of the hashes."""
    set_in = np.zeros(64 * WORDS, dtype=np.int64)
    for a in range(0, len(h), 1 << 12):
        part = h[a : a + (1 << 12), None] + _EXPAND
        part = (part ^ (part >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(29)
        set_in += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(set_in * 2 > len(h), bitorder="little").view("<u8")


def pair_keys(prints: np.ndarray, pairs: range) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of long fingerprints: a pair's number, with a codeword index of either segment."""
    bits = np.unpackbits(prints[:, 1:].copy().view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    weight = 1 << np.arange(23)
    rows, out = [], []
    for p in pairs:
        a, b = (golay_indices(bits[:, at : at + 23].astype(np.int64) @ weight) for at in (46 * p, 46 * p + 23))
        for i in range(a.shape[1]):
            for j in range(b.shape[1]):
                has = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0))
                rows.append(has)
                out.append((p << 24) | (a[has, i] << 12) | b[has, j])
    return np.concatenate(rows), np.concatenate(out)


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of key, frames that hold whole keys."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        key = b["key"].to_numpy()
        if rest and rest[-1]["key"].iloc[-1] != key[0]:
            yield pd.concat(rest)
            rest = []
        if key[0] != key[-1]:
            done = int(np.searchsorted(key, key[-1]))
            yield pd.concat([*rest, b.iloc[:done]])
            rest = []
            b = b.iloc[done:]
        rest.append(b)
    if rest:
        yield pd.concat(rest)


def _frame(u: list[np.ndarray], v: list[np.ndarray], more: list[int]) -> pd.DataFrame:
    got = pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}) if u else pd.DataFrame({"u": [], "v": []}, dtype="int64")
    got = pd.DataFrame({"u": got.min(axis=1), "v": got.max(axis=1)}).drop_duplicates().astype("Int64")
    return pd.concat([got.assign(more=pd.array([None] * len(got), dtype="Int64")), pd.DataFrame({"u": None, "v": None, "more": sorted(set(more))}, dtype="Int64")])


def _apart(first_u: np.ndarray, first_v: np.ndarray, second_u: np.ndarray, second_v: np.ndarray) -> np.ndarray:
    """Differing bits of two words of fingerprints, 99 where they are too many."""
    first = np.bitwise_count(first_u ^ first_v)
    both = first + np.bitwise_count(second_u ^ second_v)
    return np.where((first <= FIRST_BITS) & (both <= TWO_BITS), both, np.uint8(99))


def _first_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of key (key, name, two words of bits, home): near pairs of names under one key.

    Under keys of SMALL_BUCKET rows or fewer all near pairs (``few``).  Under larger ones each name that is at home there with the
    NEAREST of those before it and of all; ``more`` has the names of which that leaves pairs out.
    """
    said: set[int] = set()  # names that are in ``more`` already
    for x in _buckets(batches):
        x = x.iloc[np.lexsort((x["name"], x["key"]))]
        key, name, home = (x[c].to_numpy() for c in ("key", "name", "home"))
        first, second = (x[c].to_numpy().view(np.uint64) for c in ("bits", "second"))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        big = np.repeat(size > SMALL_BUCKET, size)
        few_u, few_v, u, v, more = [], [], [], [], [np.zeros(0, dtype=np.int64)]
        for lag in range(1, min(SMALL_BUCKET, max(size, default=1))):
            near = np.flatnonzero((key[lag:] == key[:-lag]) & ~big[lag:])
            near = near[_apart(first[near], first[near + lag], second[near], second[near + lag]) < 99]
            few_u.append(name[near])
            few_v.append(name[near + lag])
        for n in np.unique(size[size > SMALL_BUCKET]).tolist():  # keys of as many rows together
            starts, step = new[size == n], max(1, min(n, AT_ONCE // n))
            some = max(1, AT_ONCE // (n * step))
            for s in range(0, len(starts), some):
                rows = starts[s : s + some, None] + np.arange(n)
                for a in range(0, n, step):
                    own = rows[:, a : a + step]
                    i, at_home = np.arange(own.shape[1]), home[own]
                    far = _apart(first[own][:, :, None], first[rows][:, None, :], second[own][:, :, None], second[rows][:, None, :])
                    far[:, i, a + i] = 99
                    before = np.where(np.arange(n)[None, :] < (a + i)[:, None], far, np.uint8(99))
                    for d in (far, before):
                        for _ in range(NEAREST):
                            j = d.argmin(axis=2)
                            least = np.take_along_axis(d, j[:, :, None], axis=2)[:, :, 0]
                            ok = (least < 99) & at_home
                            u.append(name[own][ok])
                            v.append(np.take_along_axis(name[rows], j, axis=1)[ok])
                            np.put_along_axis(d, j[:, :, None], np.where(at_home, np.uint8(99), least)[:, :, None], axis=2)
                    more.append(name[own][(far < 99).any(axis=2)])
        said = said if len(said) < 500_000 else set()
        left = [m for m in np.unique(np.concatenate(more)).tolist() if m not in said]
        yield _frame(few_u, few_v, []).assign(few=True)
        yield _frame(u, v, left).assign(few=False)
        said.update(left)


def _other_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of key (key, name, root, size of the name's set, place of the shingle in it): pairs that may be similar.

    Roots differ, and if this is the first shingle that two sets have in common, what comes after it can still make up SIMILAR.
    """
    for x in _buckets(batches):
        key = x["key"].to_numpy()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for low, high in zip(new, np.append(new[1:], len(key)), strict=True):
            name, root, size, place = (x[c].to_numpy()[low:high] for c in ("name", "root", "size", "place"))
            rest = size - place
            step = max(1, min(256, AT_ONCE // len(name)))
            for a in range(0, len(name), step):
                most = np.minimum(rest[a : a + step, None], rest[None, a:])
                i, j = np.nonzero((root[a : a + step, None] != root[None, a:]) & (most * (1 + SIMILAR) >= SIMILAR * (size[a : a + step, None] + size[None, a:])))
                i, j = i[i < j], j[i < j]
                if len(i):
                    yield _frame([name[a + i]], [name[a + j]], [])


def _dealt(prints: DataFrame) -> DataFrame:
    """key, name and two words of long fingerprints (name, fp), a row for each key.

    Rows of a key of over LARGE_BUCKET go into chunks of half of that, and each pair of chunks is a key of its own, so all of
    them meet and none has more than LARGE_BUCKET.  Such a key has its share in some partition, so only what is frequent
    within a partition is counted.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            fp = np.frombuffer(b"".join(b["fp"]), dtype="<u8").reshape(-1, WORDS)
            name, bits = b["name"].to_numpy(), fp[:, 0].astype(np.uint64).view(np.int64)
            for p in range(PAIRS):
                rows, key = pair_keys(fp, range(p, p + 1))
                home = np.arange(len(rows)) < len(fp)  # the nearest codewords of both segments come first
                second = fp[:, WORDS - 1 if 2 * p < PAIRS else 1].astype(np.uint64).view(np.int64)  # the pair's bits are in other words
                yield pd.DataFrame({"key": key, "name": name[rows], "bits": bits[rows], "second": second[rows], "home": home})

    parts = max(1, prints.rdd.getNumPartitions())
    large = max(LARGE_BUCKET, parts)
    often = max(1, large // parts)

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One pair of segments at a time has 2^24 keys at most, whatever the partition holds.
        seen = [np.frombuffer(b"".join(b["fp"]), dtype="<u8").reshape(-1, WORDS) for b in batches if len(b)]
        few = sum(map(len, seen)) <= FEW_PRINTS
        for p in range(PAIRS):
            if few:  # sorted, these keys take less than a table of all
                key, total = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(pair_keys(fp, range(p, p + 1))[1] for fp in seen)]), return_counts=True)
                yield pd.DataFrame({"key": key[total >= often], "c": total[total >= often].astype(np.int64)})
                continue
            total = np.zeros(1 << 24, dtype=np.int32)
            for fp in seen:
                np.add.at(total, pair_keys(fp, range(p, p + 1))[1] & 0xFFFFFF, 1)
            at = np.flatnonzero(total >= often)
            yield pd.DataFrame({"key": at.astype(np.int64) | (p << 24), "c": total[at].astype(np.int64)})

    rows = in_pandas(prints.select("name", "fp"), of, "key long, name long, bits long, second long, home boolean")
    counts = in_pandas(prints.select("name", "fp"), frequent, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("in"))
    # Partitions that don't report a key have fewer than ``often`` rows of it each.
    most = F.col("c") + (F.lit(parts) - F.col("in")) * F.lit(often - 1)
    heavy = cut(counts.where(most > large).select("key", F.ceil(most * 2 / large).alias("m")))
    if not heavy.head(1):
        return rows
    spread = rows.join(heavy, "key", "left").withColumn("c", F.expr("pmod(name, m)")).withColumn("o", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))).where("m IS NULL OR o <> c")
    return spread.select(F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))).alias("key"), "name", "bits", "second", "home")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def candidates(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs u, v of names of long fingerprints (name, fp) that share a key and are near in two words, and the names that have more.

    All pairs among the names that have more are looked for by ``other_candidates``, so of these only the nearest come out here:
    the many members of a group share small keys too, and pairs under them would grow with the square of the group.
    """
    got = cut(in_pandas(_by_key(_dealt(prints)), _first_links, "u long, v long, more long, few boolean"))
    more = cut(got.where("more IS NOT NULL").select(F.col("more").alias("name")).distinct())
    few = got.where("few AND u IS NOT NULL").select("u", "v")
    alone = [few.join(more, few[x] == more["name"], "left_anti") for x in "uv"]  # one end or both have no more
    return got.where("NOT few AND u IS NOT NULL").select("u", "v").union(alone[0]).union(alone[1]).distinct(), more


def other_candidates(bodies: DataFrame, roots: DataFrame, k: int = 5) -> DataFrame:
    """Pairs u, v of names (name, body: packed words) whose roots differ and whose sets may have similarity SIMILAR or more.

    For names that have many near ones, of which most are linked already.  Exact: shingles are put in one order, whatever it is;
    two similar sets share one among so many first shingles of either that fewer than SIMILAR of it come after, and from the
    first one they share on enough must be left of both.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SHINGLE_BUCKETS, dtype=np.int64)
        for b in batches:
            for body in b["body"]:
                np.add.at(total, (shingle_set(zlib.decompress(body), k) % SHINGLE_BUCKETS).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    sums = in_pandas(bodies.select("body"), counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # columns, not rows
    table = np.zeros(SHINGLE_BUCKETS, dtype=np.int64)
    table[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    frequent = bodies.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, places, sizes = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], []
            for body in b["body"]:
                h = shingle_set(zlib.decompress(body), k)
                often = frequent.value[(h % SHINGLE_BUCKETS).astype(np.int64)]
                order = np.lexsort((h, often))[: len(h) - int(np.ceil(SIMILAR * len(h) - 1e-9)) + 1]
                place = np.flatnonzero(often[order] > 1)  # a bucket's only shingle joins nothing, but takes its place at the front
                keys.append(h[order[place]])
                places.append(place)
                sizes.append(len(h))
            each = [len(p) for p in places[1:]]
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "name": np.repeat(b["name"].to_numpy(), each), "size": np.repeat(np.array(sizes, dtype=np.int64), each), "place": np.concatenate(places)})

    prefixes = in_pandas(bodies.select("name", "body"), first, "key long, name long, size long, place long")
    prefixes = cut(prefixes.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name")))
    heavy = cut(prefixes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_BUCKET).select("key", F.ceil(F.col("n") * 2 / LARGE_BUCKET).alias("m")))
    spread = prefixes
    if heavy.head(1):
        chunk = prefixes.join(heavy, "key", "left").withColumn("m", F.coalesce("m", F.lit(1).cast("long"))).withColumn("c", F.expr("pmod(name, m)"))
        chunk = chunk.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).where("m = 1 OR o <> c")
        spread = chunk.withColumn("key", F.when(F.col("m") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o"))))
    return in_pandas(_by_key(spread.select("key", "name", "root", "size", "place")), _other_links, "u long, v long, more long").select("u", "v").distinct()


def close(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs u, v that differ in ALL_BITS or fewer."""
    a, b = (prints.select(F.col("name").alias(x), F.col("fp").alias(f"f{x}")) for x in "uv")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fu, fv = (np.frombuffer(b"".join(x[c]), dtype="<u8").reshape(-1, WORDS) for c in ("fu", "fv"))
            yield x.loc[np.bitwise_count(fu ^ fv).sum(axis=1) <= ALL_BITS, ["u", "v"]]

    return in_pandas(pairs.join(a, "u").join(b, "v"), near, "u long, v long")


def similar(pairs: DataFrame, bodies: DataFrame, k: int = 5) -> DataFrame:
    """Those of the pairs u, v whose bodies (name, body: packed words) have similarity SIMILAR or more."""

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(256)
        def hashes(body: bytes) -> np.ndarray:
            return shingle_set(zlib.decompress(body), k)

        for x in batches:
            ok = np.zeros(len(x), dtype=bool)
            for i, (p, q) in enumerate(zip(x["bu"], x["bv"], strict=True)):
                g, h = hashes(bytes(p)), hashes(bytes(q))
                if min(len(g), len(h)) >= SIMILAR * max(len(g), len(h)):
                    both = len(np.intersect1d(g, h, assume_unique=True))
                    ok[i] = both >= SIMILAR * (len(g) + len(h) - both)
            yield x.loc[ok, ["u", "v"]]

    a, b = (bodies.select(F.col("name").alias(x), F.col("body").alias(f"b{x}")) for x in "uv")
    return in_pandas(pairs.join(a, "u").join(b, "v"), verified, "u long, v long")


def _body(text: str | None) -> bytes:
    """Words with single blanks between; bytes: only A-Z count as a-z, and only the six ASCII blanks divide."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def near_dedup(docs: DataFrame, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of exact and near copies (Jaccard 0.8 or more on sets of ``k``-word shingles).

    Links are checked on the sets themselves; which pairs are looked at comes from fingerprints of the sets.

    The smallest doc_id of a group stays; a row without id only where no row of the group has one.  Of repeated rows one stays.
    Texts without a word are copies of each other.  No rows: no rows out.  Other columns pass through.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [shingle_set(_body(t), k) for t in b["text"]]
            name = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in h], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_id": b["_id"], "_t1": b["_t1"], "_t2": b["_t2"], "name": name, "fp": [long_fingerprint(x).tobytes() for x in h]})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "body": [zlib.compress(_body(t), 1) for t in b["text"]]})

    body = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.struct("*").alias("_row"), "text", F.col("doc_id").cast("long").alias("_id"), F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit("second"), body).alias("_t2"))
    rows = cut(in_pandas(named.select("_id", "_t1", "_t2", "text"), of, "_id long, _t1 long, _t2 long, name long, fp binary"))
    # One row for each name first: a name may belong to a third of all rows.
    prints = cut(rows.groupBy("name").agg(F.min("fp").alias("fp"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_t1", "_t2")).alias("x")))

    def bodies_of(names: DataFrame) -> DataFrame:
        asked = names.join(prints, "name").select("name", F.col("x._id").alias("i"), F.col("x._t1").alias("a"), F.col("x._t2").alias("b"))
        found = named.select("_id", "_t1", "_t2", "text").join(asked, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_t1") == F.col("a")) & (F.col("_t2") == F.col("b")))
        return cut(in_pandas(found.select("name", "text"), packed, "name long, body binary").dropDuplicates(["name"]))

    pairs, crowded = candidates(prints)
    pairs = cut(close(prints, pairs))
    # Texts are fetched for names in a pair, and for those that may have more, only.
    bodies = bodies_of(pairs.select(F.col("u").alias("name")).union(pairs.select("v")).union(crowded).distinct())
    links = cut(similar(pairs, bodies, k))
    roots = components(links)
    crowded = cut(bodies.join(crowded, "name", "left_semi"))
    if crowded.head(1):  # what the nearest few left apart
        links = links.union(cut(similar(other_candidates(crowded, roots, k), crowded, k)))
        roots = components(links)
    stays = prints.join(roots, prints["name"] == roots["node"], "left").groupBy(F.coalesce("root", "name").alias("root")).agg(F.min("x").alias("x"))
    stays = stays.select(F.col("x._id").alias("i"), F.col("x._t1").alias("a"), F.col("x._t2").alias("b"))
    same = named["_id"].eqNullSafe(stays["i"]) & (named["_t1"] == stays["a"]) & (named["_t2"] == stays["b"])
    return named.join(stays, same, "left_semi").dropDuplicates(["_id", "_t1", "_t2"]).select(*(F.col("_row")[c].alias(c) for c in docs.columns))

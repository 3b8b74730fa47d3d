"""Near copies at similarity 0.8, against brute force over sets of 5-word shingles."""

import random
import zlib

from loomspark.llm import simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def shingles(t, k=5):
    w = t.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(w, n, r):
    """Two texts of the words with n places changed, spread."""
    w = list(w)
    for i in r.sample(range(5, len(w) - 5, 11), n):
        w[i] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def groups_of_two(n=300):
    """Pairs at similarity 0.8 to 0.85, each alone; ids 2i and 2i + 1."""
    r, out = random.Random(8), []
    while len(out) < 2 * n:
        w = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(120, 500))]
        a, b = " ".join(w), changed(w, round(len(w) * r.uniform(0.019, 0.025)), r)
        if 0.8 <= jaccard(a, b) < 0.85:
            out += [(len(out), a), (len(out) + 1, b)]
    return out


def test_recall_at_080(spark):
    rows = groups_of_two()
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert {i for i, _ in rows[::2]} <= kept
    lost = sum(i in kept for i, _ in rows[1::2])
    assert lost <= 0.05 * len(rows) / 2, lost


def test_below_080_and_repeated_passage_stay(spark):
    r = random.Random(9)
    w = [f"w{r.randrange(10**6)}" for _ in range(400)]
    a = " ".join(w)
    b = changed(w, 12, r)
    assert 0.7 < jaccard(a, b) < 0.8
    # a passage that repeats outweighs the rest of either text, but counts once
    line = "the very same five words again " * 300
    c, d = (line + " ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "cd")
    assert jaccard(c, d) < 0.5
    kept = simhash.near_dedup(spark.createDataFrame([(0, a), (1, b), (2, c), (3, d)], SCHEMA))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 2, 3]


def test_large_keys_need_no_second_key(spark, monkeypatch):
    """All rows of a key meet, however many they are."""
    r = random.Random(10)
    one = simhash.long_fingerprint(simhash.shingle_set(b"a text of more than five words"))
    far = [one.copy() for _ in range(40)]
    for i, f in enumerate(far):  # the first pair of segments is the same, the others and the first word are not
        f[2:] = [r.randrange(2**64) for _ in f[2:]]
        f[0] = r.randrange(2**64) if i > 1 else f[0]
    prints = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(far)], "name long, fp binary")
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    assert simhash.candidates(prints)[0].where((F.col("u") == 0) & (F.col("v") == 1)).count() == 1


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Under one key, a pair that is linked but not among the nearest few, which all have other texts."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:-i] + [f"x{i}y{k}" for k in range(i)])) for i in range(1, 80)]
    ids = {i for i, _ in rows}
    group = {i: {i} for i in ids}
    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                both = group[i] | group[j]
                for x in both:
                    group[x] = both
    kept = {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert kept == {min(g) for g in group.values()}
    bodies = spark.createDataFrame([(i, zlib.compress(b.encode())) for i, b in rows], "name long, body binary")
    roots = spark.createDataFrame([(i, i % 3) for i in ids], "node long, root long")
    want = {(i, j) for i, a in rows for j, b in rows if i < j and (i - j) % 3 and jaccard(a, b) >= 0.8}
    for large in (20_000, 6):
        monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
        pairs = simhash.other_candidates(bodies, roots)
        assert {(x.u, x.v) for x in simhash.similar(pairs, bodies).collect()} == want
    assert simhash.other_candidates(bodies.limit(0), roots).count() == 0


def test_chance_meetings_are_few():
    """Texts of which none is like another: under shared keys hardly a pair is named, and no text has to meet all others."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(7)
    n, keys = 60, 400
    words = r.integers(-(1 << 63), (1 << 63) - 1, (n * keys, 2), dtype=np.int64)
    frame = pd.DataFrame({"key": np.repeat(np.arange(keys), n), "name": np.arange(n * keys), "bits": words[:, 0], "second": words[:, 1], "home": True})
    got = pd.concat(simhash._first_links(iter([frame])))
    met = keys * n * (n - 1) // 2
    assert got["u"].notna().sum() < met / 10_000 and got["more"].notna().sum() < n * keys / 100


def test_large_keys_name_all_near_ones():
    """Under a key of many near rows each is linked, or said to have more."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(8)
    for n in (3, 8, 9, 40):
        frame = pd.DataFrame({"key": 5, "name": r.permutation(n), "bits": r.choice([0, 1, 2, 4], n), "second": 0, "home": True}).astype({"bits": "int64"})
        got = pd.concat(simhash._first_links(iter([frame])))
        pairs = {(u, v) for u, v in got[["u", "v"]].dropna().itertuples(index=False)}
        assert {x for p in pairs for x in p} == {*range(n)} and all(u < v for u, v in pairs)
        assert len(pairs) == n * (n - 1) // 2 if n <= simhash.SMALL_BUCKET else {*got["more"].dropna()} == {*range(n)}


def test_pairs_of_a_group_under_small_keys(spark):
    """Candidates of a group of near copies grow with the group, not with its square, and nobody stays that has a copy."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [changed(base, 5, r) for _ in range(400)]
    rows = [(i, simhash.long_fingerprint(simhash.shingle_set(t.encode())).tobytes()) for i, t in enumerate(texts)]
    pairs, more = simhash.candidates(spark.createDataFrame(rows, "name long, fp binary").repartition(4))
    assert more.count() == len(texts)
    assert pairs.count() <= 2 * simhash.NEAREST * simhash.PAIRS * len(texts)  # each is at home under a key of each pair
    docs = [(i, t) for i, t in enumerate(texts[:150])]
    roots = [*range(150)]
    for i in range(150):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                roots = [min(roots[i], roots[j]) if x in (roots[i], roots[j]) else x for x in roots]
    assert 1 < len({*roots}) < 150
    assert {x.doc_id for x in simhash.near_dedup(spark.createDataFrame(docs, SCHEMA)).collect()} == {*roots}

"""Capped picks against plain loops: misfits, ties, caps, budgets, repeated weights."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from loomspark.operators import capped


def sha(*parts):
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()


def plain_robin(rows, cap, budget):
    queues = defaultdict(list)
    for s, k, n in rows:
        queues[s or ""].append((sha("w7", k), k, n or 0))
    order = sorted(queues, key=lambda s: sha("w7", "source", s))
    for q in queues.values():
        q.sort()
    used, total, out = Counter(), 0, []
    while True:
        progress = False
        for s in order:
            while queues[s]:
                _, k, n = queues[s].pop(0)
                if used[s] + n <= cap and total + n <= budget:
                    used[s] += n
                    total += n
                    out.append((k, s, n, len(out)))
                    progress = True
                    break
        if not progress:
            return out


def weights(seed, n, sources, most):
    r = random.Random(seed)
    return [(r.choice([None, "hot", "hot", *(f"s{i}" for i in range(sources))]), i, r.choice([None, 0, 5, 5, r.randrange(1, most)])) for i in range(n)]


@pytest.mark.parametrize("n, sources, most, cap, budget, local", [(150, 4, 60, 300, 1000, 0), (150, 4, 60, 300, 1000, 10_000), (120, 2, 200, 5000, 1500, 0), (80, 6, 30, 40, 10_000, 0), (60, 3, 50, 0, 100, 0), (60, 3, 50, 100, 0, 0)])
def test_round_robin(spark, n, sources, most, cap, budget, local):
    rows = weights(n + cap, n, sources, most)
    got = capped.round_robin(spark.createDataFrame(rows, "source string, id long, n int"), "source", "id", "n", cap, budget, local_rows=local)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == plain_robin(rows, cap, budget)


def digits(df):
    """Of the planner's size in bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().simpleString().split("=")[1].split()[0]
    return int(size.split("E+")[1]) if "E+" in size else len(size)


def test_sizes_stay_small_over_rounds(spark):
    """Whatever the number of rounds: sizes of joins are products, so they may not be carried from one to the next."""
    rows = weights(5, 150, 4, 60)
    got = capped.round_robin(spark.createDataFrame(rows, "source string, id long, n int"), "source", "id", "n", 300, 1000, local_rows=0)
    assert digits(got) < 200
    families = [(f"f{i % 40}", "ab"[i % 3 == 0], i) for i in range(200)]
    got = capped.whole_families(spark.createDataFrame(families, "family string, cls string, id long"), "family", "cls", "id", {"a": 31, "b": 17}, 4)
    assert digits(got) < 200


def test_nothing_to_pick(spark):
    got = capped.round_robin(spark.createDataFrame([], "source string, id long, n int"), "source", "id", "n", 10, 10)
    assert got.columns == ["id", "source", "weight", "place"] and got.collect() == []


def plain_families(rows, quota, cap):
    families = defaultdict(list)
    for f, c, k in rows:
        if f is not None and k is not None:
            families[f].append((sha("w8", k), k, c))
    order = sorted(families, key=lambda f: (sha("w8", f), f))
    left, taken, out = Counter(quota), set(), []
    for f in order:
        families[f].sort()
        some = families[f][:cap]
        need = Counter(c for _, _, c in some)
        if all(left[c] >= n for c, n in need.items()):
            left -= need
            taken.add(f)
            out += [(k, f, c, True) for _, k, c in some]
    for f in order:
        got = 0
        for _, k, c in families[f] if f not in taken else ():
            if (cap is None or got < cap) and left[c] > 0:
                left[c] -= 1
                got += 1
                out.append((k, f, c, False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, quota, cap", [(1, {"a": 20, "b": 9, "c": 3}, 3), (2, {"a": 10, "b": 10}, None), (3, {"a": 7, "b": 30, "c": 30}, 5), (4, {"a": 0, "b": 2}, 2), (5, {"a": 900, "b": 900, "c": 900, "d": 1}, 2)])
def test_whole_families(spark, seed, quota, cap):
    r = random.Random(seed)
    rows = [(r.choice([None, "hot", *(f"f{i}" for i in range(25))]), r.choice(["a", "a", "b", "c", None] if i % 7 else ["x"]), i if i % 50 else None) for i in range(140)]
    got = capped.whole_families(spark.createDataFrame(rows, "family string, cls string, id long"), "family", "cls", "id", quota, cap)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_families(rows, quota, cap)

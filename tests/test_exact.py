"""Families of graphs and expressions, exact values, and the guard's direction."""

import random
from fractions import Fraction
from itertools import combinations, permutations

import pytest
from loomspark.operators import exact, registry


def mask(n, edges):
    return sum(1 << i for i, p in enumerate(combinations(range(n), 2)) if p in edges or p[::-1] in edges)


def families(spark, graphs):
    return {(r.n, r.mask): r.family for r in exact.canonical(spark.createDataFrame(graphs, "n int, mask long")).collect()}


def test_isomorphic_graphs_share_a_family(spark):
    path, other, star = mask(4, [(0, 1), (1, 2), (2, 3)]), mask(4, [(2, 0), (0, 3), (3, 1)]), mask(4, [(0, 1), (0, 2), (0, 3)])
    got = families(spark, [(4, path), (4, other), (4, star), (3, mask(3, [(0, 1), (1, 2)])), (3, 7), (1, 0), (7, 1), (None, 1), (3, None), (3, 8), (3, -1)])
    assert got[4, path] == got[4, other] != got[4, star]
    assert got[3, mask(3, [(0, 1), (1, 2)])] == 3 and got[3, 7] == 7 and got[1, 0] == 0
    assert [got[k] for k in ((7, 1), (None, 1), (3, None), (3, 8), (3, -1))] == [None] * 5


@pytest.mark.parametrize("n", [2, 4, 5, 6])
def test_least_mask_over_all_orders(spark, n):
    r, pairs = random.Random(n), [*combinations(range(n), 2)]
    some = sorted({r.randrange(1 << len(pairs)) for _ in range(12)})
    got = families(spark, [(n, m) for m in some])
    for m in some:
        edges = [p for i, p in enumerate(pairs) if m >> i & 1]
        assert got[n, m] == min(mask(n, {(o[a], o[b]) for a, b in edges}) for o in permutations(range(n)))


def test_exact_arithmetic():
    assert exact.value_of("(1 + 2) / -6") == Fraction(-1, 2) and exact.value_of("+1") == 1 and exact.value_of("-+-2") == 2
    for bad in ("__import__('os')", "True", "1.5", "2 ** 3", "x"):
        with pytest.raises(ValueError):
            exact.value_of(bad)
    with pytest.raises(ZeroDivisionError):
        exact.value_of("1 / 0")


@pytest.mark.parametrize("a, b, same", [("1+2+3", "4+(5+6)", True), ("1*(2*3)", "4*5*6", True), ("1-2-3", "1-(2-3)", False), ("-1+2", "7+9", True), ("-(1+2)", "1+2", False), ("1+2*3", "2*3+1", False), ("--1", "1", False), ("+1", "1", True)])
def test_structure(a, b, same):
    assert (exact.shape_of(a) == exact.shape_of(b)) == same


def test_structure_is_compact():
    assert exact.shape_of("(1 + 2) * -3 / 4") == '["Div",["Mul",["Add","C","C"],"C"],"C"]'
    with pytest.raises(ValueError):
        exact.shape_of("2 ** 3")


def test_the_guard_wants_less_loss(spark, tmp_path):
    """A candidate that is worse by its loss isn't better, whichever way that is."""
    spark.createDataFrame([(i, f"src{i % 5}", "en") for i in range(80)], "doc_id long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    r = registry.QUERIES["A30_guard_decision"](spark, str(tmp_path)).first()
    base, cand = (registry.QUERIES["J13_paired_draw"](spark, str(tmp_path)).where("stratum = '*'").agg({c: "avg"}).first()[0] for c in ("baseline", "candidate"))
    assert r.better == (cand < base) and r.low <= r.gain <= r.high and r.accepted == (r.better and r.clear and r.worst_loss <= 2.5)

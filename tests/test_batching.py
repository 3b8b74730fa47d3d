"""Batch cuts against the plain loop, whatever the size of a block."""

import random

import pytest
from loomspark.operators import batching


def plain(rows, max_rows, budget, extra, waste):
    rows = sorted(((n or 0, k) for k, n in rows), key=lambda x: (-x[0], x[1]))
    out, i, batch = [], 0, 0
    while i < len(rows):
        w, n, used = rows[i][0], 1, rows[i][0]
        while i + n < len(rows) and n < max_rows and (w + extra) * (n + 1) <= budget and 100 * (w * (n + 1) - used - rows[i + n][0]) <= waste * w * (n + 1):
            used += rows[i + n][0]
            n += 1
        out += [(k, x, batch) for x, k in rows[i : i + n]]
        i, batch = i + n, batch + 1
    return sorted(out)


def cases(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([None, 0, 7, 7, r.randrange(1, 400), r.randrange(1, 20)])) for i in range(n)]


@pytest.mark.parametrize("n, max_rows, budget, extra, waste, block, fan", [(300, 5, 900, 0, 25, 8, 2), (300, 8, 10_000, 3, 25, 8, 3), (200, 16, 60_000, 0, 100, 4096, 256), (50, 1, 10, 5, 0, 4, 2), (1, 4, 1, 0, 25, 4, 2)])
def test_batches(spark, n, max_rows, budget, extra, waste, block, fan):
    rows = cases(n, n + max_rows)
    got = batching.batches(spark.createDataFrame(rows, "id long, chars int"), "chars", "id", max_rows, budget, extra, waste, block, fan)
    assert sorted(map(tuple, got.collect())) == plain(rows, max_rows, budget, extra, waste)


def test_no_rows(spark):
    assert batching.batches(spark.createDataFrame([], "id long, chars int"), "chars", "id").collect() == []


def test_a_batch_must_fit_a_block(spark):
    with pytest.raises(ValueError):
        batching.batches(spark.range(3).selectExpr("id", "1 AS chars"), "chars", "id", max_rows=9, block=8)

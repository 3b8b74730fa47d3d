"""The law of op2: a row lies in the shard in whose equal share of all bytes its middle byte falls, rows in scan order."""

import random

import pytest
from loomspark.llm import sharding


@pytest.mark.parametrize("n_rows, n_shards, parts, largest", [(700, 40, 7, 300), (50, 40, 3, 5000), (5, 40, 2, 10), (300, 7, 300, 90)])
def test_law(spark, n_rows, n_shards, parts, largest):
    r = random.Random(n_rows)
    rows = [(r.choice([None, i, i // 3]), r.choice([None, "", "é" * r.randrange(largest), "x" * r.randrange(largest)])) for i in range(n_rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)
    own = [(i, len((t or "").encode()) + 16) for i, t in map(tuple, d.collect())]  # in scan order
    total, before, want, slots = sum(s for _, s in own), 0, [], {}
    for i, s in own:
        shard = min(n_shards - 1, (2 * before + s) * n_shards // (2 * total))
        want.append((i, s, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += s
    got = [(x.doc_id, x.size, x.shard, x.slot) for x in sharding.shard(d, n_shards).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # each shard is within one row, at either end, of an equal share
    most = max(s for _, s in own)
    held = [sum(s for _, s, k, _ in want if k == shard) for shard in range(n_shards)]
    assert all(abs(x - total / n_shards) <= most for x in held)

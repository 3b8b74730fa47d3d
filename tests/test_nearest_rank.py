"""Values of a rank, against sorting."""

import random

from loomspark.operators import metrics
from pyspark.sql import functions as F


def test_nearest_rank(spark):
    r = random.Random(4)
    values = {"one": [0.25], "ties": [0.5] * 40, "ends": [0.0] * 3 + [1.0] * 5, "mixed": [r.choice([0.0, 1.0, 0.951, r.random()]) for _ in range(300)], "near": [0.3 + r.random() / 1e7 for _ in range(200)]}
    rows = [(a, v) for a, x in values.items() for v in x]
    r.shuffle(rows)
    got = metrics.nearest_rank(spark.createDataFrame(rows, "area string, v double").repartition(3), "area", F.col("v"), "least(n - 1, cast(floor(0.95 * n) as bigint))")
    assert {x.area: x.value for x in got.collect()} == {a: sorted(x)[min(len(x) - 1, len(x) * 95 // 100)] for a, x in values.items()}
    assert metrics.nearest_rank(spark.createDataFrame([], "area string, v double"), "area", F.col("v"), "n - 1").collect() == []

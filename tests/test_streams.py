"""Streams over events that span more than a month, and runs of failures."""

import datetime

from loomspark.operators import registry

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)


def test_repeats_months_apart(spark, tmp_path):
    for i in range(40):  # more files than one trigger takes, each 10 days on
        row = (i, START + datetime.timedelta(days=10 * i), 1, "view", 1.0, "same" if i in (0, 39) else f"p{i}")
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["X04_streaming_dedupe"](spark, str(tmp_path)).first().n == 39


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def late(user=99):
    """An event long after all others, which moves the watermark past them."""
    return (10_000, START + datetime.timedelta(days=3), user, "view", 1.0, "")


def test_breaker_needs_eight_failures(spark, tmp_path):
    runs = {1: 7, 2: 8, 3: 30, 4: 400}  # of 3 the pause of 300 s takes the rest; 4 goes on after it, where one failure is enough
    rows = [(1000 * u + i, START + datetime.timedelta(seconds=i), u, "error", 1.0, "") for u, n in runs.items() for i in range(n)]
    put(spark, tmp_path, [*rows, late()])
    got = {r.user_id: (r.trips, r.run, r.seen) for r in registry.QUERIES["X05_circuit_breaker"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 7, 7), 2: (1, 8, 8), 3: (1, 8, 8), 4: (2, 9, 9)}


def test_breaker_counts_in_order_of_time(spark, tmp_path):
    """Whatever file an event is in: here the success that comes between was written last."""
    bad = [(i, START + datetime.timedelta(seconds=10 * i), 1, "error", 1.0, "") for i in range(10)]
    put(spark, tmp_path, bad)
    put(spark, tmp_path, [(50, START + datetime.timedelta(seconds=45), 1, "click", 1.0, "")])
    put(spark, tmp_path, [late()])
    assert [(r.trips, r.run, r.seen) for r in registry.QUERIES["X05_circuit_breaker"](spark, str(tmp_path)).collect()] == [(0, 5, 11)]


def test_the_day_log_forgets(spark, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    put(spark, tmp_path, [(1, at(0), 1, "a", 1.0, ""), (2, at(1), 1, "a", 1.0, ""), (3, at(1), 1, "b", 1.0, "")])
    put(spark, tmp_path, [(4, at(24.5), 1, "a", 1.0, ""), (5, at(24.5), 2, "a", 1.0, "")])
    got = {r.event_type: (r.n, r.minutes) for r in registry.QUERIES["X03_day_eviction"](spark, str(tmp_path)).collect()}
    assert got == {"a": (3, 2), "b": (1, 1)}
    put(spark, tmp_path, [(6, at(30), 1, "c", 1.0, "")])
    got = {r.event_type: (r.n, r.minutes) for r in registry.QUERIES["X03_day_eviction"](spark, str(tmp_path)).collect()}
    assert got == {"a": (2, 1), "c": (1, 1)}


def test_a_month_of_minutes_is_forgotten_at_once(spark, tmp_path):
    """20,000 minutes in one file: no timer a minute."""
    import time

    put(spark, tmp_path, [(i, START + datetime.timedelta(minutes=i), 1, "a", 1.0, "") for i in range(20_000)])
    began = time.time()
    got = {r.event_type: (r.n, r.minutes) for r in registry.QUERIES["X03_day_eviction"](spark, str(tmp_path)).collect()}
    assert got == {"a": (1441, 1441)} and time.time() - began < 60

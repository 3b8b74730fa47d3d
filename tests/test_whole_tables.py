"""Queries that run over their whole table."""

from loomspark.operators import registry


def put(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return str(path)

EVENTS = "event_id long, user_id long, event_type string, props string"


def test_types_from_all_events(spark, tmp_path):
    rows = [(1, 7, "a", ""), (2, 7, "b", ""), (4, 8, "a", ""), *((10 + i, 9, "abcde"[i], "") for i in range(5))]
    got = registry.QUERIES["M19_type_inference"](spark, put(spark, tmp_path, "events", rows, EVENTS)).collect()
    assert {r.user_id: r.type for r in got} == {7: "noul", 8: "choice", 9: "score"}


def test_state_leaks(spark, tmp_path):
    props = ['{"event_name": "Click "}', '{"label": "view"}', '{"k": 7}', '{"note": "click"}', '{"event_name": "other"}', '{"type": "click"}']
    rows = [(i, 50, "click" if i else "view", p) for i, p in enumerate(props)]
    got = registry.QUERIES["F08_state_leaks_option"](spark, put(spark, tmp_path, "events", rows, EVENTS)).collect()
    assert sorted(r.event_id for r in got) == [0, 1]


def test_order_of_all_sources(spark, tmp_path):
    sf = put(spark, tmp_path, "documents", [(i, f"src{i}") for i in range(6)], "doc_id long, source string")
    assert sorted(r.ord for r in registry.QUERIES["W01_hash_order"](spark, sf).collect()) == [1, 2, 3, 4, 5, 6]


def test_option_names(spark, tmp_path):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 700: "ZX", 702: "ZZ", 703: "AAA", 18278: "ZZZ", 18279: "AAAA", 20000: "ACOF"}
    sf = put(spark, tmp_path, "part", [(i,) for i in want], "p_partkey long")
    assert {r.i: r.name for r in registry.QUERIES["M01_option_names"](spark, sf).collect()} == want


def test_results_and_suite(spark, tmp_path):
    put(spark, tmp_path, "orders", [(10,), (11,), (20,)], "o_orderkey long")
    sf = put(spark, tmp_path, "lineitem", [(10,), (11,), (30,)], "l_orderkey long")
    assert {r.side: r.n for r in registry.QUERIES["J01_results_x_suite"](spark, sf).collect()} == {"both": 2, "missing": 1, "outside": 1}


def test_ranks_take_no_group_whole(spark):
    """Windows of W16 and W27 are by ranges of a hash, or by part type; none is over all rows or all of a signature."""
    import re

    from loomspark.operators import selection
    from loomspark.plans.dialect import SPARK

    rows = r"row_number\(\) OVER \((?:PARTITION BY ([a-z_., ]+?) )?ORDER BY"
    assert re.findall(rows, selection.group_sample(SPARK)) == ["o.signature, o.q"]
    assert set(re.findall(rows, selection.distractors(SPARK))) == {"p_type", "q", "f.p_partkey"}

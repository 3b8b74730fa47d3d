"""Small cases of semantics that are easy to get wrong."""

import gzip
import json

from loomspark.operators import greedy, sets
from loomspark.sources import files
from pyspark.sql import functions as F


def test_jsonl_splits_on_line_feed_only(spark, tmp_path):
    texts = ["a\u2028b\u0085c", "plain"]
    (tmp_path / "x.jsonl").write_text("\n\n".join(json.dumps({"t": t}, ensure_ascii=False) for t in texts), encoding="utf-8")
    assert sorted(r.t for r in files.read_jsonl(spark, str(tmp_path), "t string").collect()) == sorted(texts)


def test_tolerant_and_strict_reads(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"t": "a"}\n{"t": \n')
    assert files.read_jsonl(spark, str(tmp_path), "t string", "tolerant").count() == 1
    assert files.read_jsonl(spark, str(tmp_path), "t string").where("_corrupt is not null").count() == 1


def test_fnv_vector(spark):
    assert spark.range(1).select(greedy.fnv1a(F.lit("a"))).first()[0] == 0xE40C292C


def test_merged_families(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "u long, v long")
    assert {r.node: r.family for r in sets.merged_families(links).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7}


def test_suppliers_and_customers_meet_under_an_order_only(spark, tmp_path):
    """Orders of one customer of a nation with 3000 customers and 3000 suppliers: no join by nation alone."""
    from loomspark.operators import registry

    put = lambda name, sql: spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    put("customer", "SELECT id AS c_custkey, CAST(1 AS INT) AS c_nationkey FROM range(3000)")
    put("supplier", "SELECT id AS s_suppkey, CAST(id % 2 AS INT) AS s_nationkey FROM range(3000)")
    put("orders", "SELECT id AS o_orderkey, IF(id = 3, NULL, id % 3000) AS o_custkey FROM range(6)")
    put("lineitem", "SELECT id DIV 2 AS l_orderkey, id * id AS l_suppkey FROM range(10)")
    df = registry.QUERIES["J09_exhaustive_oracle"](spark, str(tmp_path))
    assert sorted(r.anchor for r in df.collect()) == [0, 1, 2, 4]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "nation" in x and "o_orderkey" not in x and "l_orderkey" not in x]

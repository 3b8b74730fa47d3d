"""Trees of any depth against a plain walk."""

import json

from loomspark.operators import trees
from pyspark.sql import functions as F

TREES = ['{"a": {"b": [1, {"c": null, "d": "x"}], "e": 1.5}, "f": true}', '[[["deep"]], {"k": {"k": [{"k": 0}]}}]', '"only"', "7", "null", "{}", "[]", "{bad", None, '{"z": 1, "é": "ü", "a": {"y": [], "b": {}}}']


def walk(v, path="$", name=None, above=False):
    kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "null" if v is None else "scalar"
    listed = above or kind == "list"
    yield path, name, kind, listed, v
    if kind == "object":
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}", k, listed)
    elif kind == "list":
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]", None, listed)


def parsed():
    for i, t in enumerate(TREES):
        try:
            if t is not None:
                yield i, json.loads(t)
        except ValueError:
            pass


def frame(spark):
    return spark.createDataFrame([*enumerate(TREES)], "id long, t string")


def test_nodes(spark):
    want = {(i, *node[:4]) for i, v in parsed() for node in walk(v)}
    got = trees.nodes(frame(spark), "id", "t").collect()
    assert {(r.id, r.path, r.name, r.kind, r.listed) for r in got} == want and len(got) == len(want)


def test_leaves(spark):
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    want = {(i, path, text(v)) for i, t in parsed() for path, _, kind, _, v in walk(t) if kind == "scalar"}
    assert {(r.id, r.path, r.value) for r in trees.leaves(frame(spark), "id", "t").collect()} == want


def test_forbidden_keys(spark):
    got = {(r.id, r.path) for r in trees.forbidden_keys(frame(spark), "id", "t", ["k", "d"]).collect()}
    assert got == {(0, "$.a.b[1].d"), (1, "$[1].k"), (1, "$[1].k.k"), (1, "$[1].k.k[0].k")}


def test_canonical_json(spark):
    want = {i: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for i, v in parsed()}
    got = {r.id: r.c for r in frame(spark).select("id", trees.canonical_json(F.col("t")).alias("c")).collect()}
    assert {i: c for i, c in got.items() if c is not None} == want and got[7] is None and got[8] is None


def test_no_trees(spark):
    assert trees.nodes(frame(spark).limit(0), "id", "t").collect() == []

"""Prefixes are compared to the end of the shorter text."""

from loomspark.operators import registry


def put(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return str(path)


def test_whole_prefix(spark, tmp_path):
    w = [f"w{i}" for i in range(200)]
    texts = [w, w, [*w[:100], "x", *w[101:]], w[:70], [], None]
    sf = put(spark, tmp_path, "documents", [(i, "s", None if t is None else " ".join(t)) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.a_id: (r.prefix, r.rounded) for r in registry.QUERIES["T08_common_prefix"](spark, sf).collect()}
    assert got == {0: (200, 192), 1: (100, 64), 2: (70, 64), 3: (0, 0), 4: (0, 0)}

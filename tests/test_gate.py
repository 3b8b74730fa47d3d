"""The gate looks at documents of every language and of none."""

from loomspark.operators import registry


def put(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return str(path)


def test_leaks_in_any_language_close_the_gate(spark, tmp_path):
    put(spark, tmp_path, "benchmark", [(1, "a protected item")], "item_id long, text string")
    sf = put(spark, tmp_path, "documents", [(1, "has a protected item in it", "en"), (2, "a protected item", None), (3, "nothing", "fr")], "doc_id long, text string, lang string")
    got = registry.QUERIES["M16_gate"](spark, sf).first()
    assert (got.hits, got.open) == (2, False)

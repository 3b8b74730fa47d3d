"""Every part has its menu."""

from collections import defaultdict

from loomspark.operators import registry


def put(spark, path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    return str(path)


def test_menus(spark, tmp_path):
    types = {i: "big" if i < 30 else f"small{i % 5}" if i < 50 else "alone" for i in range(51)}
    sf = put(spark, tmp_path, "part", [(i, t, "b") for i, t in types.items()], "p_partkey long, p_type string, p_brand string")
    menus = defaultdict(dict)
    for r in registry.QUERIES["W27_distractor_menu"](spark, sf).collect():
        menus[r.part_id][r.rn] = r.other
    assert set(menus) == set(types)
    for part, menu in menus.items():
        assert sorted(menu) == list(range(1, 16)) and len({*menu.values()} - {part}) == 15
        own = min(15, sum(t == types[part] for t in types.values()) - 1)
        assert [types[menu[i]] == types[part] for i in range(1, 16)] == [True] * own + [False] * (15 - own)

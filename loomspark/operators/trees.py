"""JSON trees on VARIANT: canonical text, all nodes with their paths, leaves, forbidden keys.

A tree is taken apart level by level; each level is one lateral explode of the objects and lists that the one above left, so the
work follows the number of nodes and there are as many rounds as the deepest tree has levels.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .registry import query

_KIND = "CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'list' WHEN is_variant_null(v) THEN 'null' ELSE 'scalar' END"


def canonical_json(text: Column) -> Column:
    """Compact JSON with keys in order and characters as they are; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """id, path, name, kind, value and listed of every node of each row's JSON; text that is no JSON has none.

    path: $, then .name or [place] a level.  kind: object, list, scalar or null.  value: text of a scalar, JSON of the rest.
    listed: whether a list is among the node and what holds it.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("id"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("above"), F.to_json(F.try_parse_json(column)).alias("json")).where("json IS NOT NULL")
    out = []
    while True:
        view = f"nodes_{uuid.uuid4().hex}"
        level.withColumn("v", F.try_parse_json("json")).createOrReplaceTempView(view)
        here = cut(spark.sql(f"SELECT id, path, name, {_KIND} AS kind, json, CASE WHEN {_KIND} = 'scalar' THEN cast(v AS string) ELSE json END AS value, above OR {_KIND} = 'list' AS listed FROM {view}"))
        out.append(here.drop("json"))
        inner = here.where("kind IN ('object', 'list')")
        if not inner.head(1):
            return reduce(DataFrame.unionByName, out)
        inner.withColumn("v", F.try_parse_json("json")).createOrReplaceTempView(view)
        level = spark.sql(f"SELECT id, path || CASE WHEN kind = 'list' THEN '[' || e.pos || ']' ELSE '.' || e.key END AS path, e.key AS name, listed AS above, to_json(e.value) AS json FROM {view}, LATERAL variant_explode(v) AS e")


def leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """id, path, name, value and listed of the scalars that aren't null."""
    return nodes(df, key, column).where("kind = 'scalar'").drop("kind")


def forbidden_keys(df: DataFrame, key: str, column: str, forbidden: list[str]) -> DataFrame:
    """id and path of every node, at any depth, whose key is forbidden."""
    return nodes(df, key, column).where(F.col("name").isin(forbidden)).select("id", "path")


@query("P13_P14_flatten_tree", """SELECT event_id, t.fullkey AS path, CASE WHEN t.fullkey NOT LIKE '%]' THEN t.key END AS name, t.atom ->> '$' AS value, t.fullkey LIKE '%[%' AS listed FROM events, json_tree(json_object('event', event_type, 'tags', [user_id, event_id], 'props', props::JSON)) t WHERE t.atom IS NOT NULL""")
def flatten(spark, sf_dir):
    """Leaves of the events' trees with their paths, and whether they lie in a list."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tree = F.concat(F.lit('{"event":"'), "event_type", F.lit('","tags":['), "user_id", F.lit(","), "event_id", F.lit('],"props":'), "props", F.lit("}"))
    return leaves(events.select("event_id", tree.alias("tree")), "event_id", "tree").select(F.col("id").alias("event_id"), "path", "name", "value", "listed")


@query("P15_forbidden_paths", """SELECT event_id, t.fullkey AS path FROM events, json_tree(json_object('a', [json_object('k', event_type), json_object('gold', user_id)], 'props', props::JSON)) t WHERE t.key IN ('k', 'gold')""")
def forbidden(spark, sf_dir):
    """Paths of forbidden keys, in lists of objects too."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    tree = F.concat(F.lit('{"a":[{"k":"'), "event_type", F.lit('"},{"gold":'), "user_id", F.lit('}],"props":'), "props", F.lit("}"))
    return forbidden_keys(events.select("event_id", tree.alias("tree")), "event_id", "tree", ["k", "gold"]).select(F.col("id").alias("event_id"), "path")


@query("N_canonical_json", """SELECT event_id, CAST(json_object('a', props::JSON, 'b', event_type) AS VARCHAR) AS canonical FROM events""")
def canonical(spark, sf_dir):
    """Keys in order, no blanks, whatever order they come in."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", canonical_json(F.concat(F.lit('{"b" : "'), "event_type", F.lit('", "a" : '), "props", F.lit("}"))).alias("canonical"))

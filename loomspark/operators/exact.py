"""Exact families: undirected graphs up to the names of their nodes, arithmetic in fractions, expressions up to their constants."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship
from .registry import query

MOST_NODES = 6


def relabelings(spark: SparkSession, most: int = MOST_NODES) -> DataFrame:
    """n and to: for each order of n nodes, where the bit of each pair of nodes goes; 873 rows for six nodes at the most."""
    rows = []
    for n in range(1, most + 1):
        pairs = [frozenset(p) for p in combinations(range(n), 2)]
        place = {p: i for i, p in enumerate(pairs)}
        for order in permutations(range(n)):
            rows.append((n, [place[frozenset(map(order.__getitem__, p))] for p in pairs]))
    return spark.createDataFrame(rows, "n int, to array<int>")


def canonical(graphs: DataFrame, n: str = "n", mask: str = "mask") -> DataFrame:
    """``graphs`` with family, the least mask that some order of the nodes gives.

    A graph of n nodes is a mask over its pairs of nodes, (0,1) first.  Each different graph is worked out once, in the JVM, against
    the broadcast table of orders.  Null or out of range: null family.
    """
    each = graphs.select(F.col(n).cast("int").alias("_n"), F.col(mask).cast("long").alias("_m")).distinct()
    each = each.where(F.col("_n").between(1, MOST_NODES) & (F.col("_m") >= 0) & (F.col("_m") < F.expr("shiftleft(1L, cast(_n * (_n - 1) / 2 AS int))")))
    moved = F.expr("aggregate(sequence(0, size(to)), 0L, (sum, i) -> sum + CASE WHEN i < size(to) AND getbit(_m, i) = 1 THEN shiftleft(1L, to[i]) ELSE 0L END)")
    orders = F.broadcast(relabelings(graphs.sparkSession))
    least = each.join(orders, F.col("_n") == orders["n"]).groupBy("_n", "_m").agg(F.min(moved.try_cast("long")).alias("family"))
    return graphs.join(least, (graphs[n] == least["_n"]) & (graphs[mask] == least["_m"]), "left").drop("_n", "_m")


def value_of(expression: str) -> Fraction:
    """Exact value of + - * / over whole numbers, signs included; anything else is refused."""
    two = {ast.Add: Fraction.__add__, ast.Sub: Fraction.__sub__, ast.Mult: Fraction.__mul__, ast.Div: Fraction.__truediv__}
    one = {ast.USub: Fraction.__neg__, ast.UAdd: Fraction.__pos__}

    def go(n: ast.AST) -> Fraction:
        if isinstance(n, ast.BinOp) and type(n.op) in two:
            return two[type(n.op)](go(n.left), go(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in one:
            return one[type(n.op)](go(n.operand))
        if isinstance(n, ast.Constant) and type(n.value) is int:
            return Fraction(n.value)
        raise ValueError("not allowed")

    return go(ast.parse(expression, mode="eval").body)


def shape_of(expression: str) -> str:
    """The expression without its numbers, as compact JSON: sums within sums and products within products are one, a signed number
    is a number, and order counts.  Anything but whole numbers, + - * / and signs is refused."""
    names = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div"}

    def go(n: ast.AST) -> object:
        match n:
            case ast.Constant(value=int()) if type(n.value) is int:
                return "C"
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return go(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                inner = go(x)
                return "C" if inner == "C" and isinstance(x, ast.Constant) else ["Neg", inner]
            case ast.BinOp(op=op) if type(op) in names:
                name, out = names[type(op)], [names[type(op)]]
                for x in map(go, (n.left, n.right)):
                    out += x[1:] if name in ("Add", "Mul") and x[0] == name else [x]
                return out
        raise ValueError("not allowed")

    return json.dumps(go(ast.parse(expression, mode="eval").body), separators=(",", ":"))


def per_expression(df: DataFrame, column: str, name: str, f: Callable[[str], object]) -> DataFrame:
    """``df`` with f of an expression as text; what f refuses, divides by zero or can't read is null."""

    def one(x: str | None) -> str | None:
        try:
            return str(f(x)) if x is not None else None
        except (ValueError, ZeroDivisionError, SyntaxError, RecursionError, MemoryError):
            return None

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: [*map(one, b[column])]})

    ship(df.sparkSession)
    return df.mapInPandas(of, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, {name} string")


@query("N_exact_arithmetic", """WITH x AS (SELECT p_partkey, p_size, p_partkey + p_size AS a, p_size - 7 AS b FROM part), g AS (SELECT *, gcd(a, b) AS g FROM x)
    SELECT p_partkey, '(' || p_partkey || ' + ' || p_size || ') / (+' || p_size || ' - 7)' AS e, CASE WHEN b = 0 THEN NULL WHEN a % b = 0 THEN (a // b)::VARCHAR ELSE (sign(b) * a // g)::BIGINT || '/' || (abs(b) // g)::BIGINT END AS value FROM g""")
def arithmetic(spark, sf_dir):
    """Fractions as text; what can't be computed is null."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return per_expression(parts.select("p_partkey", F.format_string("(%d + %d) / (+%d - 7)", "p_partkey", "p_size", "p_size").alias("e")), "e", "value", value_of)


@query("N_structure_family", """SELECT p_partkey, sha256(CASE p_size % 6 WHEN 0 THEN '["Add","C","C","C"]' WHEN 1 THEN '["Add","C","C","C"]' WHEN 2 THEN '["Mul","C",["Sub","C","C"],"C"]' WHEN 3 THEN '["Neg",["Add","C","C"]]' WHEN 4 THEN '["Sub",["Sub","C","C"],"C"]' END) AS family FROM part""")
def structure(spark, sf_dir):
    """Programs that differ in numbers, grouping of sums or signs of numbers share a family; what is no program has none."""
    n = F.col("p_partkey").cast("string")
    forms = ["(a + 2) + -3", "-a + (2 + 3)", "a * ((4 - a) * 5)", "-(a + 2)", "(a - 2) - a", "2 ** a"]
    text = F.element_at(F.array(*map(F.lit, forms)), F.col("p_size").cast("int") % 6 + 1)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.replace(text, F.lit("a"), n).alias("e"))
    return per_expression(parts, "e", "shape", shape_of).select("p_partkey", F.sha2("shape", 256).alias("family"))


GRAPH_SQL = """WITH RECURSIVE p AS (SELECT * FROM (SELECT unnest(range(5)) AS a) t, (SELECT unnest(range(5)) AS b) u, (SELECT unnest(range(5)) AS c) v, (SELECT unnest(range(5)) AS d) w, (SELECT unnest(range(5)) AS e) x WHERE len(list_distinct([a, b, c, d, e])) = 5),
    bits AS (SELECT * FROM (VALUES (0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 1, 5), (4, 2, 3), (5, 2, 4), (6, 2, 5), (7, 3, 4), (8, 3, 5), (9, 4, 5)) AS t(i, x, y)),
    o AS (SELECT row_number() OVER () AS r, [a, b, c, d, e] AS q FROM p), t AS (SELECT r, b.i, z.i AS j FROM o CROSS JOIN bits b JOIN bits z ON z.x = least(q[b.x], q[b.y]) + 1 AND z.y = greatest(q[b.x], q[b.y]) + 1),
    m AS (SELECT DISTINCT p_partkey % 1024 AS mask FROM part), s AS (SELECT mask, r, sum(CASE WHEN (mask >> i) & 1 = 1 THEN 1::BIGINT << j ELSE 0 END) AS v FROM m CROSS JOIN t GROUP BY mask, r)
    SELECT p_partkey, (SELECT min(v)::BIGINT FROM s WHERE s.mask = p_partkey % 1024) AS family FROM part"""


@query("N_canonical_graph", GRAPH_SQL)
def graphs(spark, sf_dir):
    """One graph over five nodes for each part; isomorphic ones share a family."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(5).alias("n"), (F.col("p_partkey") % 1024).alias("mask"))
    return canonical(parts).select("p_partkey", "family")

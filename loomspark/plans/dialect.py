"""Expressions that the engine and the SQL oracle spell differently.

A plan is a function of a dialect that returns SQL.  Rendered for Spark it is what the engine runs; rendered for DuckDB it is
the oracle of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"

    def s(self, x): return f"cast({x} as string)"
    def sha(self, x): return f"sha2({x}, 256)"
    def h8(self, x): return f"cast(conv(substring(sha2({x}, 256), 1, 8), 16, 10) as bigint)"
    def each(self, a): return f"explode({a})"
    def at(self, a, i): return f"get({a}, cast({i} as int) - 1)"
    def size(self, a): return f"size({a})"
    def map(self, a, x, e): return f"transform({a}, {x} -> {e})"
    def keep(self, a, x, e): return f"filter({a}, {x} -> {e})"
    def total(self, a): return f"aggregate({a}, cast(0 as double), (acc, e) -> acc + e)"
    def seq(self, a, b): return f"(case when {b} >= {a} then sequence({a}, {b}) else cast(array() as array<int>) end)"
    def arr(self, *x): return f"array({', '.join(x)})"
    def part(self, a, i, n): return f"slice({a}, {i}, {n})"
    def join(self, a, sep): return f"array_join({a}, '{sep}')"
    def words(self, t, pattern): return f"regexp_extract_all({t}, r'{pattern}', 0)"
    def like(self, t, pattern): return f"({t} rlike r'{pattern}')"
    def extract(self, t, pattern, g): return f"regexp_extract({t}, r'{pattern}', {g})"
    def sub(self, t, pattern, to): return f"regexp_replace({t}, r'{pattern}', '{to}')"
    def div(self, a, b): return f"(({a}) div ({b}))"
    def half_even(self, x): return f"rint({x})"
    def int(self, x): return f"cast(floor({x}) as bigint)"
    def collect(self, x, order): return f"transform(array_sort(collect_list(struct({order} as o, {x} as x))), e -> e.x)"
    def gather(self, x): return f"array_sort(collect_set({x}))"
    def quantile(self, x, p): return f"percentile({x}, {p})"
    def json(self, t, path): return f"get_json_object({t}, '{path}')"
    def epoch(self, t): return f"unix_micros(cast({t} as timestamp))"
    def distinct(self, a): return f"array_distinct({a})"
    def common(self, a, b): return f"array_intersect({a}, {b})"
    def has(self, a, x): return f"array_contains({a}, {x})"
    def where_in(self, a, x): return f"array_position({a}, {x})"
    def sorted(self, a): return f"array_sort({a})"
    def chars(self, t): return f"char_length({t})"
    def code(self, t): return f"ascii({t})"
    def xor(self, a, b): return f"(({a}) ^ ({b}))"
    def starts(self, t, p): return f"startswith({t}, {p})"
    def holds(self, t, p): return f"contains({t}, {p})"
    def from_code(self, n): return f"char({n})"
    def double(self, x): return f"cast({x} as double)"


class Duck(Spark):
    name = "duck"

    def s(self, x): return f"cast({x} as varchar)"
    def sha(self, x): return f"sha256({x})"
    def h8(self, x): return f"('0x' || substr(sha256({x}), 1, 8))::BIGINT"
    def each(self, a): return f"unnest({a})"
    def at(self, a, i): return f"list_extract({a}, {i})"
    def size(self, a): return f"len({a})"
    def map(self, a, x, e): return f"list_transform({a}, lambda {x}: {e})"
    def keep(self, a, x, e): return f"list_filter({a}, lambda {x}: {e})"
    def total(self, a): return f"coalesce(list_sum({a}), 0)::DOUBLE"
    def seq(self, a, b): return f"generate_series({a}, {b})"
    def arr(self, *x): return f"[{', '.join(x)}]"
    def part(self, a, i, n): return f"list_slice({a}, {i}, ({i}) + ({n}) - 1)"
    def join(self, a, sep): return f"array_to_string({a}, '{sep}')"
    def words(self, t, pattern): return f"regexp_extract_all({t}, '{self._re(pattern)}')"
    def like(self, t, pattern): return f"regexp_matches({t}, '{self._re(pattern)}')"
    def extract(self, t, pattern, g): return f"regexp_extract({t}, '{self._re(pattern)}', {g})"
    def sub(self, t, pattern, to): return f"regexp_replace({t}, '{self._re(pattern)}', '{to}', 'g')"
    def div(self, a, b): return f"(({a}) // ({b}))"
    def half_even(self, x): return f"round_even({x}, 0)"
    def int(self, x): return f"floor({x})::BIGINT"
    def collect(self, x, order): return f"list({x} ORDER BY {order})"
    def gather(self, x): return f"list_sort(list(DISTINCT {x}))"
    def quantile(self, x, p): return f"quantile_cont({x}, {p})"
    def json(self, t, path): return f"json_extract_string({t}, '{path}')"
    def epoch(self, t): return f"epoch_us({t})"
    def distinct(self, a): return f"list_distinct({a})"
    def common(self, a, b): return f"list_intersect({a}, {b})"
    def has(self, a, x): return f"list_contains({a}, {x})"
    def where_in(self, a, x): return f"coalesce(list_position({a}, {x}), 0)"
    def sorted(self, a): return f"list_sort({a})"
    def chars(self, t): return f"length({t})"
    def xor(self, a, b): return f"xor({a}, {b})"
    def starts(self, t, p): return f"starts_with({t}, {p})"
    def from_code(self, n): return f"chr(({n})::INTEGER)"

    @staticmethod
    def _re(pattern: str) -> str:
        """The oracle's regex engine has no (?U); its \\w is ASCII."""
        return pattern.replace(r"(?U)\w", r"[\p{L}\p{N}_]")


SPARK, DUCK = Spark(), Duck()
Plan = Callable[[Spark], str]


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables of a folder."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)

"""Registry of the engine's queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.dialect import DUCK, SPARK, Plan, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "M14_benchmark_overlap"


def plan(name: str) -> Callable[[Plan], Plan]:
    """Registers a plan under ``name``: rendered for Spark as the query, for DuckDB as its oracle."""

    def keep(f: Plan) -> Plan:
        QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir, f(SPARK))
        ORACLES[name] = f(DUCK)
        return f

    return keep


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir), with SQL for its oracle where there is some."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


from . import batching, calibrate, capped, dedup, exact, greedy, metrics, protected, records, selection, sets, similar, trees  # noqa: E402, F401  they register their plans
from ..sources import archive, files, ledger  # noqa: E402, F401
from ..streaming import events  # noqa: E402, F401

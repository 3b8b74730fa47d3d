"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.lineage import cut  # noqa: F401  the operators take it from here
from loomspark.functions.lineage import shared as shared_folder  # noqa: F401
from loomspark.functions.workers import ship

#: A word: a run of anything but space and the five control blanks.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> F.Column:
    """Array of words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def row_id() -> F.Column:
    """Place of a row in its scan: partition in the upper bits, position below."""
    return F.monotonically_increasing_id()


def in_pandas(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas`` with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(f, schema)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)

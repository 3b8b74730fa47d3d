"""The folder that the driver and all executors share; cuts the lineage of iterative work there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder under spark.checkpoint.dir; where none is named, a local one is made, which serves a local master only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A name for a new folder in the shared one."""
    return f"{shared(spark)}/loomspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from the written rows."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, by way of a table: what goes on has the size of its files.

    For loops with joins.  A checkpoint keeps the planner's size of what led to it, for a join the product of both sides; in a loop
    that number gets several times as many digits in every round, until it fills the driver.
    """
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

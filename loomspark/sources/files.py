"""File sources and sinks: JSON lines (strict, tolerant, compressed), CSV, JSON arrays, XML.

Each query writes a table in the format to the cluster's shared folder and returns what the reader makes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..operators.registry import query


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines, split on LF alone; blank lines are skipped; compression goes by the file's name.

    strict: bad lines are rows with ``_corrupt``.  tolerant: bad lines go.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    if mode == "tolerant":
        return parsed.where(F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")
    return parsed.select("r.*")


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One compact object a line, characters beyond ASCII as they are; the commit protocol makes the write atomic."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("compression", compression).text(path)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")


@query("S01_S13_jsonl", "SELECT doc_id, lang, text FROM documents")
def jsonl(spark, sf_dir):
    path = scratch(spark)
    write_jsonl(_docs(spark, sf_dir), path)
    return read_jsonl(spark, path, "doc_id long, lang string, text string").drop("_corrupt")


@query("S02_tolerant_jsonl", "SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0")
def tolerant(spark, sf_dir):
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "lang"))
    _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return read_jsonl(spark, path, "doc_id long, lang string", "tolerant")


@query("S03_strict_jsonl", "SELECT doc_id % 5 = 0 AS bad, count(*) AS n FROM documents GROUP BY doc_id % 5 = 0")
def strict(spark, sf_dir):
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "lang"))
    _docs(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return read_jsonl(spark, path, "doc_id long, lang string").groupBy(F.col("_corrupt").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


@query("S04_gzip_jsonl", "SELECT doc_id, lang FROM documents")
def gzip_jsonl(spark, sf_dir):
    path = scratch(spark)
    write_jsonl(_docs(spark, sf_dir).select("doc_id", "lang"), path, "gzip")
    return read_jsonl(spark, path, "doc_id long, lang string").drop("_corrupt")


@query("S05_csv", "SELECT p_partkey, p_name, p_brand FROM part")
def csv(spark, sf_dir):
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand").write.csv(path, sep=";", header=True)
    return spark.read.csv(path, sep=";", header=True, multiLine=True, schema="p_partkey long, p_name string, p_brand string")


@query("S06_json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(spark, sf_dir):
    path = scratch(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nations.groupBy().agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)
    return spark.read.json(path, multiLine=True, schema="n_nationkey long, n_name string")


@query("S09_xml", "SELECT r_regionkey, r_name FROM region")
def xml(spark, sf_dir):
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name").write.format("xml").option("rowTag", "region").option("rootTag", "regions").save(path)
    return spark.read.format("xml").option("rowTag", "region").schema("r_regionkey long, r_name string").load(path)


@query("S10_parquet_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def projection(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity").where("l_quantity > 49")


@query("S18_report", """SELECT '| ' || source || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY source""")
def report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("source").agg(F.count("*").alias("n")).select(F.format_string("| %s | %d |", "source", "n").alias("line"))

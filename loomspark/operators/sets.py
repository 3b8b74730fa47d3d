"""Set operations on pools: union, intersection, difference, replacement, and union-find of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..plans.reads import questions
from .registry import plan, query


@plan("U01_concat_pools")
def concat(d):
    return "SELECT 'a' AS pool, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id FROM documents WHERE lang <> 'en'"


@plan("U02_U04_collisions")
def collisions(d):
    """Ids, families and states of two pools; each should share nothing."""
    return f"""WITH a AS (SELECT * FROM documents WHERE doc_id % 2 = 0), b AS (SELECT * FROM documents WHERE doc_id % 2 = 1)
    SELECT 'id' AS kind, count(*) AS n FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b) x UNION ALL SELECT 'family', count(*) FROM (SELECT source FROM a INTERSECT SELECT source FROM b) y
    UNION ALL SELECT 'state', count(*) FROM (SELECT {d.sha('text')} AS h FROM a INTERSECT SELECT {d.sha('text')} FROM b) z"""


@plan("U03_split_leakage")
def leakage(d):
    return f"SELECT {d.sha('text')} AS state, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY {d.sha('text')} HAVING count(DISTINCT doc_id % 3) > 1"


@plan("U05_difference")
def difference(d):
    return "SELECT 'missing' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) a UNION ALL SELECT 'outside', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) b"


@plan("U06_replace_slots")
def replace_slots(d):
    """Chosen slots go, candidates of the same type come in; totals by type stay."""
    return f"""WITH {questions(d)}, slot AS (SELECT id, qid, type, row_number() OVER (PARTITION BY type ORDER BY {d.sha("'s' || " + d.s('id'))}, id) AS rn FROM ql), gone AS (SELECT id, qid, type, rn FROM slot WHERE rn <= 20),
    cand AS (SELECT {d.s('item_id')} AS id, rn FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) b WHERE rn <= 20)
    SELECT {d.s('ql.id')} AS id, ql.qid, ql.type FROM ql LEFT JOIN gone ON ql.id = gone.id AND ql.qid = gone.qid WHERE gone.id IS NULL UNION ALL SELECT 'cand-' || cand.id, gone.qid, gone.type FROM gone JOIN cand ON gone.rn = cand.rn"""


@plan("U07_S17_additive_prefix")
def additive(d):
    """A pool with rows added: the base must be its prefix in both directions."""
    return """WITH base AS (SELECT doc_id, text FROM documents WHERE lang <> 'es'), rung AS (SELECT doc_id, text FROM documents WHERE lang <> 'es' UNION ALL SELECT item_id + 1000000000, text FROM benchmark)
    SELECT (SELECT count(*) FROM (SELECT * FROM base EXCEPT ALL SELECT * FROM rung) a) AS lost, (SELECT count(*) FROM (SELECT * FROM rung EXCEPT ALL SELECT * FROM base) b) AS added"""


@plan("U08_lineage_caps")
def lineage_caps(d):
    return """WITH alias AS (SELECT 'src1' AS source, 'src0' AS root UNION ALL SELECT 'src2', 'src0'), x AS (SELECT coalesce(alias.root, a.source) AS root, n_chars FROM documents a LEFT JOIN alias ON a.source = alias.source) SELECT root, count(*) AS n, count(*) <= 200 AS within_cap FROM x GROUP BY root"""


def merged_families(links: DataFrame) -> DataFrame:
    """node and its family, the least node it is linked to, by shrinking labels until they rest; each round is cut off in the shared folder.  links: u, v."""
    both = cut(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"))
    while True:
        seen = both.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = label.join(seen, "u").select("u", F.least("label", "near").alias("label"))
        # jump: the label of the label
        new = new.join(new.select(F.col("u").alias("label"), F.col("label").alias("next")), "label", "left").select("u", F.coalesce("next", "label").alias("label"))
        new = cut(new)
        if not new.join(label.withColumnRenamed("label", "was"), "u").where("label <> was").head(1):
            return new.select(F.col("u").alias("node"), F.col("label").alias("family"))
        label = new


@query("U09_union_find", """WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS u, 1000000 + c_nationkey * 10 + c_custkey % 3 AS v FROM customer), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    r AS (SELECT u AS node, u AS family FROM b UNION SELECT b.v, r.family FROM r JOIN b ON r.node = b.u) SELECT node, min(family) AS family FROM r GROUP BY node""")
def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return merged_families(c.select(F.col("c_custkey").cast("long").alias("u"), (1_000_000 + F.col("c_nationkey") * 10 + F.col("c_custkey") % 3).cast("long").alias("v")))

"""Sequential selections and trees: what plain expressions can't say.

The greedy selectors depend on every choice before, so one group is one task's work.  They run over groups (a source, a language)
that fit a task, or over summaries of bounded size; rows go in hash order where a source would draw at random.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workers import ship
from .registry import query


def by_group(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(lambda part: f(part), schema)  # f may have more parameters, with defaults


def docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", "text")


@query("W18_hold_out_families")
def hold_out(spark, sf_dir):
    """Families held out one by one while every language keeps rows in the remainder; works on counts by family and language."""
    counts = docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))

    def pick(part: pd.DataFrame, wanted: int = 5) -> pd.DataFrame:
        table = part.pivot_table(index="source", columns="lang", values="n", fill_value=0, aggfunc="sum")
        left, held = table.sum(), []
        for s in sorted(table.index):
            if len(held) < wanted and ((left - table.loc[s]) > 0).all():
                left = left - table.loc[s]
                held.append(s)
        return pd.DataFrame({"source": held})

    return by_group(counts, "one", pick, "source string")


@query("W19_audit_sample", """WITH r AS (SELECT doc_id, source, sha256('audit:' || doc_id) AS h, row_number() OVER (PARTITION BY source ORDER BY sha256('audit:' || doc_id), doc_id) AS rn FROM documents)
    SELECT doc_id, source FROM r ORDER BY CASE WHEN rn <= 5 THEN 0 ELSE 1 END, h LIMIT 120""")
def audit(spark, sf_dir):
    """Five of each family, then filled up by hash order to 120."""
    from pyspark.sql import Window

    h = F.sha2(F.concat(F.lit("audit:"), F.col("doc_id")), 256)
    rows = docs(spark, sf_dir).select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(h, "doc_id")).alias("rn"), h.alias("h"))
    return rows.orderBy(F.when(F.col("rn") <= 5, 0).otherwise(1), "h").limit(120).select("doc_id", "source")


FNV_SQL = "WITH RECURSIVE s AS (SELECT n_name AS t, 2166136261::BIGINT AS h, 1 AS i FROM nation UNION ALL SELECT t, (xor(h, ascii(substr(t, i, 1))::BIGINT) * 16777619::HUGEINT % 4294967296)::BIGINT, i + 1 FROM s WHERE i <= length(t)) SELECT t AS n_name, h AS fnv FROM s WHERE i = length(t) + 1"


def fnv1a(text) -> F.Column:
    """32-bit FNV-1a over code points."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))).cast("decimal(20,0)") * 16777619 % 4294967296).cast("long")
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


@query("W24_fnv_hash", FNV_SQL)
def fnv(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", fnv1a(F.col("n_name")).alias("fnv"))


@query("W24_seeded_shuffle")
def shuffle(spark, sf_dir):
    """Fisher-Yates over four options by a 32-bit generator that FNV-1a seeds."""

    def order(seed: int, n: int = 4) -> list[int]:
        out, mask = list(range(n)), 0xFFFFFFFF
        for i in range(n - 1, 0, -1):
            seed = (seed + 0x6D2B79F5) & mask
            t = ((seed ^ seed >> 15) * (seed | 1)) & mask
            t = (t ^ (t + ((t ^ t >> 7) * (t | 61) & mask))) & mask
            j = ((t ^ t >> 14) & mask) * (i + 1) >> 32
            out[i], out[j] = out[j], out[i]
        return out

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "options": [order(int(s)) for s in b["seed"]]})

    ship(spark)
    return docs(spark, sf_dir).select("doc_id", fnv1a(F.concat_ws(":", "source", "doc_id")).alias("seed")).mapInPandas(of, "doc_id long, options array<int>")


@query("W26_tie_bands", """WITH RECURSIVE m AS (SELECT source, avg(n_chars) AS score FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, source) AS i FROM m),
    r AS (SELECT source, score, i, score AS leader, 1 AS band FROM o WHERE i = 1 UNION ALL SELECT o.source, o.score, o.i, CASE WHEN leader - o.score > 90 THEN o.score ELSE leader END, CASE WHEN leader - o.score > 90 THEN band + 1 ELSE band END FROM r JOIN o ON o.i = r.i + 1)
    SELECT source, score, band FROM r""")
def tie_bands(spark, sf_dir):
    """Groups of a ranking within a width of their leader; works on one row for each source."""
    means = docs(spark, sf_dir).groupBy("source").agg(F.avg("n_chars").alias("score")).withColumn("one", F.lit(1))

    def bands(part: pd.DataFrame, width: float = 90) -> pd.DataFrame:
        part = part.sort_values(["score", "source"], ascending=[False, True])
        band, leader, out = 0, None, []
        for s in part["score"]:
            if leader is None or leader - s > width:
                band, leader = band + 1, s
            out.append(band)
        return pd.DataFrame({"source": part["source"], "score": part["score"], "band": out})

    return by_group(means, "one", bands, "source string, score double, band int")


@query("P20_length_matched_window")
def length_window(spark, sf_dir):
    """Lines around a hashed start, grown to either side until 300 characters are reached."""

    def of(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches_:
            rows = []
            for i, t, h in zip(b["doc_id"], b["text"], b["h"], strict=True):
                lines = (t or "").split("\n")
                a = z = int(h) % len(lines)
                while sum(map(len, lines[a : z + 1])) < 300 and (a > 0 or z < len(lines) - 1):
                    a, z = max(0, a - 1), min(len(lines) - 1, z + 1)
                rows.append((i, a, z))
            yield pd.DataFrame(rows, columns=["doc_id", "first_line", "last_line"])

    ship(spark)
    return docs(spark, sf_dir).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")).mapInPandas(of, "doc_id long, first_line int, last_line int")


@query("P25_markdown_sections", r"""SELECT item_id, regexp_extract('## Name' || chr(10) || text || chr(10) || '## Rest' || chr(10) || 'end', '(?ms)^## Name\n(.*?)(?:^## |\z)', 1) AS body FROM benchmark""")
def sections(spark, sf_dir):
    report = F.concat(F.lit("## Name\n"), "text", F.lit("\n## Rest\nend"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.regexp_extract(report, r"(?ms)^## Name\n(.*?)(?=^## |\z)", 1).alias("body"))

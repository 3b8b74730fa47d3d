"""Deterministic order, splits, quotas, balance, samples, ranks and top-k; hash order stands where a source would draw at random."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.places import placed, running
from ..plans.dialect import DUCK, SPARK
from ..plans.reads import draws, reads
from .registry import plan, query


def hashed(d, salt, key):
    return d.sha(f"'{salt}:' || {d.s(key)}")


@query("W01_hash_order", f"SELECT doc_id, row_number() OVER (ORDER BY {hashed(DUCK, 'salt', 'doc_id')}, doc_id) AS ord FROM documents")
def hash_order(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{hashed(SPARK, 'salt', 'doc_id')} AS h")
    return placed(rows, F.col("h"), F.col("doc_id")).select("doc_id", (F.col("place") + 1).alias("ord"))


@plan("W02_family_split")
def family_split(d):
    return f"SELECT doc_id, CASE WHEN {d.h8("'set:' || source || '/' || lang")} % 100 < 5 THEN 'calib' ELSE 'train' END AS split FROM documents"


@plan("W03_hash_typing")
def hash_typing(d):
    return f"SELECT doc_id, CASE WHEN {d.h8(d.s('doc_id'))} % 2 = 0 THEN 'choice' ELSE 'noul' END AS type, {d.h8(d.s('doc_id'))} % 5 = 0 AS holdout FROM documents"


@plan("W04_round_robin")
def round_robin(d):
    """One of each stratum in turn, in hash order, 100 in all."""
    return f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed(d, 'rr', 'o_orderkey')}, o_orderkey) AS rn FROM orders),
    s AS (SELECT *, row_number() OVER (ORDER BY rn, o_orderpriority) AS place FROM r WHERE rn <= 100) SELECT place, o_orderkey, o_orderpriority FROM s WHERE place <= 100"""


@plan("W05_family_round_robin")
def family_round_robin(d):
    return f"""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY {hashed(d, 'q', 'doc_id')}, doc_id) AS rn FROM documents),
    s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rn, {d.sha('source')}) AS place FROM r) SELECT lang, place, doc_id, source FROM s WHERE place <= 30"""


@plan("W06_round_robin_unused")
def round_robin_unused(d):
    """A second round that skips what the first took and rows that fail a check."""
    return f"""WITH v AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 1000), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed(d, 'one', 'o_orderkey')}) AS rn FROM v), a AS (SELECT o_orderkey FROM r WHERE rn <= 10),
    u AS (SELECT v.*, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed(d, 'two', 'v.o_orderkey')}) AS rn FROM v WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderkey = v.o_orderkey)) SELECT o_orderkey, o_orderpriority, rn FROM u WHERE rn <= 10"""


def running_groups(spark, sf_dir: str, salt: str):
    """Conversations in hash order with the turns up to and with each."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.expr(hashed(SPARK, salt, "conv_id")))
    return running(placed(turns, F.col("h"), F.col("conv_id")), [], "place", total=F.col("n"))


@query("W09_group_prefix_budget", f"""WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, sum(n) OVER (ORDER BY {hashed(DUCK, 'p', 'conv_id')} ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY {hashed(DUCK, 'p', 'conv_id')}) AS rn FROM g)
    SELECT conv_id, n, total::BIGINT AS total FROM r WHERE total <= 50 OR rn = 1""")
def group_prefix(spark, sf_dir):
    """Whole groups while the running total stays in budget; the first is always taken, the first overflow ends it."""
    return running_groups(spark, sf_dir, "p").where("total <= 50 OR place = 0").select("conv_id", "n", "total")


@query("W10_whole_records_overshoot", f"""WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, sum(n) OVER (ORDER BY {hashed(DUCK, 'o', 'conv_id')} ROWS UNBOUNDED PRECEDING) - n AS before_it FROM g) SELECT conv_id, n FROM r WHERE before_it < 50""")
def overshoot(spark, sf_dir):
    """Whole groups until the quota is reached; the last may pass it."""
    return running_groups(spark, sf_dir, "o").where("total - n < 50").select("conv_id", "n")


@plan("W11_water_filling")
def water_filling(d):
    """Even quotas under each family's stock: the level is found over families by stock, closed form."""
    return f"""WITH f AS (SELECT source, count(*) AS stock FROM documents GROUP BY source), q AS (SELECT {d.div('sum(stock)', '2')} AS total FROM f),
    r AS (SELECT source, stock, row_number() OVER (ORDER BY stock, source) AS rn, count(*) OVER () AS k, sum(stock) OVER (ORDER BY stock, source ROWS UNBOUNDED PRECEDING) - stock AS below FROM f),
    l AS (SELECT r.*, {d.div('(total - below)', '(k - rn + 1)')} AS level FROM r, q), c AS (SELECT min(level) AS level FROM l WHERE level <= stock)
    SELECT source, stock, least(stock, coalesce(c.level, stock)) AS quota FROM r, c"""


@plan("W12_share_budget")
def share_budget(d):
    return f"""WITH {reads(d)}, c AS (SELECT count(*) AS q, count(*) FILTER (WHERE type = 'score') AS s FROM ql) SELECT q, s, {d.int('(0.4 * q - s) / (1 - 0.4)')} AS budget, {d.int('0.2 / 0.8 * q')} AS by_share FROM c"""


@plan("W13_label_balance")
def label_balance(d):
    """All of the minority; of the majority 1.5 times as many, the least confident first."""
    return f"""WITH {reads(d)}, x AS (SELECT id, fam, label, conf, row_number() OVER (PARTITION BY fam, label ORDER BY conf, id) AS rn FROM rd WHERE type = 'noul' AND rep = 0), c AS (SELECT fam, label, count(*) AS n FROM x GROUP BY fam, label), m AS (SELECT fam, min(n) AS least_n FROM c GROUP BY fam HAVING count(*) = 2)
    SELECT x.id, x.fam, x.label FROM x JOIN m ON x.fam = m.fam WHERE rn <= {d.int('1.5 * least_n')}"""


@plan("W14_n_per_class")
def n_per_class(d):
    return f"""SELECT doc_id, quality, toxic, rn FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {hashed(d, 'class', 'doc_id')}, doc_id) AS rn FROM labels) x WHERE rn <= 8"""


@plan("W15_bucket_fallback")
def bucket_fallback(d):
    """Toxic rows first, then the fallback pool, 40 in each language."""
    return f"""WITH x AS (SELECT a.doc_id, lang, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS prio FROM documents a JOIN labels b ON a.doc_id = b.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY prio, {hashed(d, 'b', 'doc_id')}) AS rn FROM x) SELECT doc_id, lang, prio FROM r WHERE rn <= 40"""


def range_of(h: str) -> str:
    """One of 4096 ranges of a hash; Spark ranks within them, after what the ranges before hold, so no window takes in all rows."""
    return f"coalesce(substr({h}, 1, 3), '')"


@plan("W16_whole_group_sample")
def group_sample(d):
    """A tenth, rounded up, of the orders of each signature of return flags, with all their lines."""
    ranks = f"r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY {hashed(d, 'grp', 'grp')}, grp) AS rn, count(*) OVER (PARTITION BY signature) AS n FROM s)"
    if d is SPARK:
        ranks = f"""h AS (SELECT *, {hashed(d, 'grp', 'grp')} AS hs FROM s), c AS (SELECT signature, {range_of('hs')} AS q, count(*) AS c FROM h GROUP BY signature, {range_of('hs')}),
    o AS (SELECT signature, q, sum(c) OVER (PARTITION BY signature ORDER BY q) - c AS ahead, sum(c) OVER (PARTITION BY signature) AS n FROM c),
    r AS (SELECT grp, ahead + row_number() OVER (PARTITION BY o.signature, o.q ORDER BY hs, grp) AS rn, n FROM h JOIN o ON h.signature = o.signature AND {range_of('hs')} = o.q)"""
    return f"""WITH s AS (SELECT l_orderkey AS grp, {d.join(d.gather('l_returnflag'), '+')} AS signature FROM lineitem GROUP BY l_orderkey), {ranks},
    k AS (SELECT grp FROM r WHERE rn <= {d.div('n + 9', '10')}) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT grp FROM k)"""


@plan("W17_donor_slots")
def donor_slots(d):
    """Slots for replacement: as many as asked, capped by type and by a tenth of all."""
    return f"""WITH {reads(d)}, t AS (SELECT type, count(*) AS n FROM ql GROUP BY type), r AS (SELECT id, qid, type, row_number() OVER (PARTITION BY type ORDER BY {hashed(d, 'donor', 'id')}, id) AS rn FROM ql) SELECT r.id, r.qid, r.type, rn FROM r JOIN t ON r.type = t.type WHERE rn <= least(25, {d.div('n', '10')})"""


@plan("W20_group_bootstrap")
def bootstrap(d):
    """Paired stratified group bootstrap with 2000 replicates: each draws as many groups of a stratum as it has, by hash."""
    return f"""WITH {reads(d)}, {draws(d)},
    m AS (SELECT dr.replicate, sum(i.candidate - i.baseline) / sum(i.n) AS delta FROM dr JOIN i ON dr.stratum = i.stratum AND dr.slot = i.slot GROUP BY dr.replicate)
    SELECT count(*) AS replicates, round(avg(delta), 5) AS mean_delta, round({d.quantile('delta', '0.025')}, 5) AS low, round({d.quantile('delta', '0.975')}, 5) AS high FROM m"""


@plan("W21_interleave_sizes")
def interleave(d):
    return f"""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY {hashed(d, 'j', 'doc_id')}) - 1 AS j FROM documents) SELECT doc_id, CASE j % 4 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 255 END AS size FROM r"""


@plan("W22_dedupe_keep_first")
def keep_first(d):
    return f"""SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY {d.sha('text')} ORDER BY {hashed(d, 'k', 'doc_id')}, doc_id) AS rn FROM documents) x WHERE rn = 1"""


@plan("W23_oversample")
def oversample(d):
    return f"""SELECT {d.s('doc_id')} AS id, toxic FROM labels UNION ALL SELECT {d.s('doc_id')} || '#dup2', toxic FROM labels WHERE toxic = 1"""


@plan("W25_best_of")
def best_of(d):
    """The best changed run against an anchor; the anchor stays if none beats it."""
    return f"""WITH {reads(d)}, h AS (SELECT fam, rep, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc FROM rd GROUP BY fam, rep), a AS (SELECT fam, acc FROM h WHERE rep = 0), b AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY acc DESC, rep) AS rn FROM h WHERE rep > 0)
    SELECT a.fam, CASE WHEN b.acc > a.acc THEN b.rep ELSE 0 END AS chosen FROM a JOIN b ON a.fam = b.fam AND b.rn = 1"""


@plan("W27_distractor_menu")
def distractors(d):
    """Fifteen other parts for every part, of its own type first: those that follow it, in a ring, in hash order."""
    before, place, total, rows = "", "row_number() OVER (ORDER BY hs, p_partkey)", "count(*) OVER () AS total", "h"
    if d is SPARK:
        before = f" c AS (SELECT {range_of('hs')} AS q, count(*) AS c FROM h GROUP BY {range_of('hs')}), t AS (SELECT q, sum(c) OVER (ORDER BY q) - c AS ahead, sum(c) OVER () AS total FROM c),"
        place, total, rows = "ahead + row_number() OVER (PARTITION BY q ORDER BY hs, p_partkey)", "total", f"h JOIN t ON {range_of('hs')} = q"
    return f"""WITH h AS (SELECT p_partkey, coalesce(p_type, '') AS p_type, {hashed(d, 'menu', 'p_partkey')} AS hs FROM part),{before}
    p AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY hs, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_type) AS n, {place} - 1 AS g, {total} FROM {rows}),
    a AS (SELECT p_partkey, p_type, r, n, {d.each(d.seq('1', 'cast(least(15, n - 1) as int)'))} AS j FROM p), same AS (SELECT a.p_partkey AS part_id, o.p_partkey AS other, a.j AS rn FROM a JOIN p o ON o.p_type = a.p_type AND o.r = (a.r + a.j) % a.n),
    f AS (SELECT p_partkey, p_type, n, g, total, {d.each(d.seq('1', 'cast(least(29, total - 1) as int)'))} AS j FROM p WHERE n < 16), rest AS (SELECT f.p_partkey AS part_id, o.p_partkey AS other, f.n - 1 + row_number() OVER (PARTITION BY f.p_partkey ORDER BY f.j) AS rn FROM f JOIN p o ON o.g = (f.g + f.j) % f.total AND o.p_type <> f.p_type)
    SELECT part_id, other, rn FROM same UNION ALL SELECT part_id, other, rn FROM rest WHERE rn <= 15"""


@plan("W28_latest_complete")
def latest_complete(d):
    """Latest finished order of each customer, and which of the others go if three are retained."""
    return f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS latest FROM orders)
    SELECT o_custkey, o_orderkey, o_orderkey = latest AS resume_here, rn > 3 AS deleted FROM r WHERE latest IS NOT NULL"""


@plan("T01_cap_first_n")
def cap(d):
    return "SELECT doc_id, ord FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50) a) x"


@plan("T02_argmax_first_tie")
def argmax(d):
    """Weights in tenths make ties; the first listed key wins."""
    return f"""WITH {reads(d)}, x AS (SELECT id, qid, k, round(p, 1) AS p FROM rk WHERE rep = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id, qid ORDER BY p DESC, k) AS rn FROM x) SELECT id, qid, k AS pick FROM r WHERE rn = 1"""


@plan("T03_argmax_preferred_tie")
def preferred(d):
    return f"""WITH {reads(d)}, x AS (SELECT id, qid, k, label, round(p, 1) AS p FROM rk WHERE rep = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id, qid ORDER BY p DESC, CASE WHEN k = label THEN 0 ELSE 1 END, k) AS rn FROM x) SELECT id, qid, k AS pick FROM r WHERE rn = 1"""


@plan("T04_floor_imputation")
def floor_imputation(d):
    """Keys under 0.1 count as missing and get the least value seen."""
    return f"""WITH {reads(d)}, x AS (SELECT id, qid, k, CASE WHEN p >= 0.1 THEN p END AS p FROM rk WHERE rep = 0) SELECT id, qid, k, round(coalesce(p, min(p) OVER (PARTITION BY id, qid)), 6) AS p, sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id, qid) AS missing FROM x"""


@plan("T05_top2_gap")
def top2(d):
    return f"""WITH {reads(d)}, o AS (SELECT id, qid, p, row_number() OVER (PARTITION BY id, qid ORDER BY p DESC) AS rn FROM rk WHERE rep = 0) SELECT id, qid, round(max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END), 6) AS gap FROM o GROUP BY id, qid"""


@plan("T06_length_buckets")
def length_buckets(d):
    return f"""WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS rn FROM documents), b AS (SELECT source, {d.div('rn', '64')} AS bucket, n_chars FROM o) SELECT source, bucket, count(*) AS n, max(n_chars) AS padded_to, sum(n_chars) AS used FROM b GROUP BY source, bucket"""


@plan("T08_common_prefix")
def common_prefix(d):
    """Longest common prefix, in words, of neighbours by id in a source; rounded down to 64."""
    return f"""WITH x AS (SELECT doc_id, source, {d.words("coalesce(text, '')", '[^ \\n]+')} AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), p AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id, a.w AS aw, b.w AS bw, cast(least({d.size('a.w')}, {d.size('b.w')}) as int) AS n FROM x a JOIN x b ON a.source = b.source AND b.rn = a.rn + 1),
    e AS (SELECT a_id, b_id, n, {d.keep(d.seq('1', 'n'), 'i', f"{d.at('aw', 'i')} <> {d.at('bw', 'i')}")} AS differ FROM p), l AS (SELECT a_id, b_id, CASE WHEN {d.size('differ')} = 0 THEN n ELSE {d.at('differ', '1')} - 1 END AS prefix FROM e)
    SELECT a_id, b_id, prefix, {d.div('prefix', '64')} * 64 AS rounded FROM l"""


@plan("T09_leaderboard")
def leaderboard(d):
    return f"""WITH {reads(d)}, h AS (SELECT fam, round(avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END), 6) AS acc FROM rd WHERE rep = 0 GROUP BY fam) SELECT row_number() OVER (ORDER BY CASE WHEN fam IN ('src0', 'src1') THEN 0 ELSE 1 END, acc DESC, fam) AS place, fam, acc FROM h"""

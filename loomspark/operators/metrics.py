"""Metrics of probability reads: accuracy, losses, calibration, robustness, coverage, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..plans.dialect import DUCK, SPARK, run
from ..plans.reads import draws, reads
from .registry import plan, query

#: Cells of equal width that values from 0 to 1 are counted in before one of them is sorted.
CELLS = 1 << 16


@plan("A01_pool_summary")
def pool_summary(d):
    return f"""WITH {reads(d)} SELECT coalesce(type, '*') AS type, coalesce(subset, '*') AS subset, count(*) AS questions, count(DISTINCT id) AS records
    FROM ql GROUP BY GROUPING SETS ((), (type), (subset), (type, subset))"""


@plan("A02_composition_shares")
def composition(d):
    return f"""WITH {reads(d)}, g AS (SELECT subset, type, count(*) AS n FROM ql GROUP BY subset, type)
    SELECT subset, type, n, round({d.double('n')} / sum(n) OVER (), 6) AS share, {d.div('n + 7', '8')} AS steps FROM g"""


@plan("A03_histograms")
def histograms(d):
    return f"""WITH {reads(d)} SELECT 'fam_type' AS kind, fam || '/' || type AS bar, count(*) AS n FROM ql GROUP BY fam, type
    UNION ALL SELECT 'fam', fam, count(*) FROM ql GROUP BY fam UNION ALL SELECT 'type', type, count(*) FROM ql GROUP BY type"""


@plan("A04_accuracy")
def accuracy(d):
    return f"""WITH {reads(d)} SELECT coalesce(subset, '*') AS subset, count(*) AS n, round(avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END), 6) AS accuracy
    FROM rd WHERE rep = 0 GROUP BY ROLLUP (subset)"""


@plan("A05_majority_floor")
def majority_floor(d):
    return f"""WITH {reads(d)}, c AS (SELECT qid, label, count(*) AS n FROM ql GROUP BY qid, label),
    s AS (SELECT label, sum(n) AS n FROM c GROUP BY label), m AS (SELECT qid, max(n) AS n FROM c GROUP BY qid)
    SELECT 'set' AS level, round({d.double('max(n)')} / {d.double('sum(n)')}, 6) AS floor FROM s
    UNION ALL SELECT 'question', round({d.double('(SELECT sum(n) FROM m)')} / {d.double('(SELECT sum(n) FROM c)')}, 6)"""


@plan("A06_decision_score_accuracy")
def decision_score(d):
    return f"""WITH {reads(d)}, a AS (SELECT subset, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc, count(*) AS n FROM rd WHERE rep = 0 GROUP BY subset),
    l AS (SELECT subset, label, count(*) AS c FROM ql GROUP BY subset, label), f AS (SELECT subset, max(c) AS top FROM l GROUP BY subset)
    SELECT a.subset, round(CASE WHEN top < n THEN (acc - {d.double('top')} / n) / (1 - {d.double('top')} / n) END, 6) AS score FROM a JOIN f ON a.subset = f.subset"""


@plan("A07_brier")
def brier(d):
    return f"""WITH {reads(d)} SELECT type, round(avg(brier), 6) AS brier, round(avg((1 - plabel) * (1 - plabel)), 6) AS one_term FROM rd GROUP BY type"""


@plan("A08_nll")
def nll(d):
    return f"""WITH {reads(d)} SELECT type, round(avg(-ln(greatest(plabel, 1e-12))), 6) AS nll FROM rd GROUP BY type"""


@plan("A09_ranked_probability_score")
def rps(d):
    return f"""WITH {reads(d)} SELECT subset, round(avg(rps), 6) AS rps, count(*) AS n FROM rd WHERE type = 'score' GROUP BY subset"""


@plan("A10_decision_score_prior")
def decision_score_prior(d):
    """Loss of the reads against that of the label base rate of their type; the score type goes by ranked probability."""
    return f"""WITH {reads(d)}, q AS (SELECT id, qid, type, nk, label, avg(CASE WHEN type = 'score' THEN rps ELSE brier END) AS loss FROM rd GROUP BY id, qid, type, nk, label),
    t AS (SELECT type, count(*) AS n FROM q GROUP BY type), b AS (SELECT q.type, q.label AS k, {d.double('count(*)')} / max(t.n) AS p FROM q JOIN t ON q.type = t.type GROUP BY q.type, q.label),
    c AS (SELECT type, k, p, sum(p) OVER (PARTITION BY type ORDER BY k) AS cp FROM b),
    e AS (SELECT q.id, q.qid, q.type, max(q.loss) AS loss, CASE WHEN q.type = 'score' THEN sum((cp - CASE WHEN k >= label THEN 1 ELSE 0 END) * (cp - CASE WHEN k >= label THEN 1 ELSE 0 END)) / (max(nk) - 1)
      ELSE sum((p - CASE WHEN k = label THEN 1 ELSE 0 END) * (p - CASE WHEN k = label THEN 1 ELSE 0 END)) END AS prior_loss FROM q JOIN c ON q.type = c.type GROUP BY q.id, q.qid, q.type)
    SELECT type, round(100 * (1 - avg(loss) / avg(prior_loss)), 4) AS score FROM e GROUP BY type"""


@plan("A11_ece_half_even")
def ece(d):
    return f"""WITH {reads(d)}, b AS (SELECT least(9, {d.int(d.half_even('100 * conf') + ' / 10')}) AS bin, conf, CASE WHEN pick = label THEN 1e0 ELSE 0e0 END AS hit FROM rd),
    g AS (SELECT bin, count(*) AS n, abs(avg(conf) - avg(hit)) AS gap FROM b GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM g"""


@plan("A12_ece_left_closed")
def ece_left_closed(d):
    return f"""WITH {reads(d)}, b AS (SELECT k, p, label, least(9, {d.int('10 * p')}) AS bin FROM rk WHERE type = 'noul' AND k = 1),
    g AS (SELECT bin, count(*) AS n, abs(avg(p) - avg(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END)) AS gap FROM b GROUP BY bin) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM g"""


@plan("A13_reliability_table")
def reliability(d):
    """All ten bins; empty ones with nulls."""
    return f"""WITH {reads(d)}, b AS (SELECT least(9, {d.int(d.half_even('100 * conf') + ' / 10')}) AS bin, conf, CASE WHEN pick = label THEN 1e0 ELSE 0e0 END AS hit FROM rd),
    g AS (SELECT bin, count(*) AS n, avg(conf) AS conf, avg(hit) AS hit FROM b GROUP BY bin), a AS (SELECT {d.each(d.seq('0', '9'))} AS bin)
    SELECT a.bin, coalesce(n, 0) AS n, round(conf, 6) AS confidence, round(hit, 6) AS accuracy FROM a LEFT JOIN g ON a.bin = g.bin"""


@plan("A14_flip_rates")
def flip_rates(d):
    return f"""WITH {reads(d)}, q AS (SELECT type, id, qid, count(DISTINCT pick) FILTER (WHERE order_seed = 0) AS same, count(DISTINCT pick) AS any_order, count(*) AS n FROM rd GROUP BY type, id, qid)
    SELECT type, round(avg(CASE WHEN same > 1 THEN 1e0 ELSE 0e0 END), 6) AS flip_rate, round(avg(CASE WHEN any_order > 1 THEN 1e0 ELSE 0e0 END), 6) AS order_flip_rate FROM q WHERE n > 1 GROUP BY type"""


@plan("A15_flip_listing")
def flip_listing(d):
    return f"""WITH {reads(d)}, o AS (SELECT *, row_number() OVER (PARTITION BY id, qid, rep ORDER BY p DESC, k) AS rn FROM rk),
    g AS (SELECT id, qid, rep, max(CASE WHEN rn = 1 THEN k END) AS pick, max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END) AS gap FROM o GROUP BY id, qid, rep)
    SELECT id, qid, count(DISTINCT pick) AS picks, round(max(gap), 6) AS max_gap, {d.join(d.collect(d.s('pick'), 'rep'), ',')} AS reads FROM g GROUP BY id, qid HAVING count(DISTINCT pick) > 1"""


@plan("A16_score_mae")
def score_mae(d):
    return f"""WITH {reads(d)} SELECT subset, round(avg(abs(expected - label)), 6) AS mae FROM rd WHERE type = 'score' GROUP BY subset"""


def _passes(d):
    """Reads 1 and 2 as perturbed passes of read 0: w, a row for each of them."""
    return f"""WITH {reads(d)}, v AS (SELECT a.id, a.qid, a.type, b.rep, max(abs(a.p - b.p)) AS dp, sum(abs(a.p - b.p)) / 2 AS tv FROM rk a JOIN rk b ON a.id = b.id AND a.qid = b.qid AND a.k = b.k AND a.rep = 0 AND b.rep > 0 GROUP BY a.id, a.qid, a.type, b.rep),
    w AS (SELECT v.*, CASE WHEN x.pick = y.pick THEN 1 ELSE 0 END AS agree, CASE WHEN x.pick = x.label THEN 1 ELSE 0 END AS base_right, CASE WHEN y.pick = y.label THEN 1 ELSE 0 END AS pass_right
      FROM v JOIN rd x ON v.id = x.id AND v.qid = x.qid AND x.rep = 0 JOIN rd y ON v.id = y.id AND v.qid = y.qid AND v.rep = y.rep)"""


def _nonce(d):
    return f"""{_passes(d)},
    z AS (SELECT type AS area, w.* FROM w UNION ALL SELECT 'all', w.* FROM w), r AS (SELECT area, dp, tv, row_number() OVER (PARTITION BY area ORDER BY dp) - 1 AS i, row_number() OVER (PARTITION BY area ORDER BY tv) - 1 AS j, count(*) OVER (PARTITION BY area) AS n FROM z),
    p AS (SELECT area, max(CASE WHEN i = least(n - 1, {d.int('0.95 * n')}) THEN dp END) AS p95_dp, max(CASE WHEN j = least(n - 1, {d.int('0.95 * n')}) THEN tv END) AS p95_tv FROM r GROUP BY area),
    q AS (SELECT area, id, qid, min(agree) AS steady FROM z GROUP BY area, id, qid), f AS (SELECT area, avg(1e0 - steady) AS any_flip FROM q GROUP BY area)
    SELECT z.area, round(avg(agree * 1e0), 6) AS agreement, round(max(any_flip), 6) AS any_flip, round(avg(dp), 6) AS mean_dp, round(max(p95_dp), 6) AS p95_dp, round(avg(tv), 6) AS mean_tv, round(max(p95_tv), 6) AS p95_tv,
      round(avg(base_right * 1e0), 6) AS accuracy_base, round(avg(pass_right * 1e0), 6) AS accuracy_passes, round(avg(CASE WHEN rep = 1 THEN pass_right * 1e0 END), 6) AS accuracy_pass1, round(avg(CASE WHEN rep = 2 THEN pass_right * 1e0 END), 6) AS accuracy_pass2,
      sum(CASE WHEN base_right = 1 AND pass_right = 0 THEN 1 ELSE 0 END) AS right_to_wrong, sum(CASE WHEN base_right = 0 AND pass_right = 1 THEN 1 ELSE 0 END) AS wrong_to_right
    FROM z JOIN f ON z.area = f.area JOIN p ON z.area = p.area GROUP BY z.area"""


def nearest_rank(values: DataFrame, area: str, value: Column, rank: str) -> DataFrame:
    """area and value: the one of the rank (SQL over n, the rows of the area; from 0) in order, without sorting an area.

    Values from 0 to 1 are counted by cells first; only the cell that holds the rank is put in order, equal values as one.
    """
    rows = values.select(area, value.alias("value"), F.floor(value * CELLS).alias("cell"))
    upto, whole = Window.partitionBy(area).orderBy("cell"), Window.partitionBy(area)
    cells = rows.groupBy(area, "cell").agg(F.count("*").alias("c")).select(area, "cell", "c", (F.sum("c").over(upto) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))
    hit = cells.withColumn("i", F.expr(rank)).where("before <= i AND i < before + c").select(area, "cell", (F.col("i") - F.col("before")).alias("i"))
    few = rows.join(F.broadcast(hit), [area, "cell"]).groupBy(area, "value").agg(F.count("*").alias("c"), F.first("i").alias("i"))  # hit: a row for each area
    return few.withColumn("upto", F.sum("c").over(Window.partitionBy(area).orderBy("value"))).where("upto - c <= i AND i < upto").select(area, "value")


@query("A17_nonce_robustness", _nonce(DUCK))
def nonce(spark, sf_dir):
    """Perturbed passes by type and (all) over all types, with nearest-rank 95th percentiles at int(0.95 n).

    Passes are written once; types are summed before they are joined, so no task has the rows of a whole type.
    """
    w = written(run(spark, sf_dir, f"{_passes(SPARK)} SELECT id, qid, type, rep, dp, tv, agree, base_right, pass_right FROM w"))
    areas = F.explode(F.array("type", F.lit("all"))).alias("area")
    z = w.select(areas, *w.columns)
    steady = w.groupBy("type", "id", "qid").agg(F.min("agree").alias("steady"))
    flips = steady.select(areas, "steady").groupBy("area").agg(F.avg(1 - F.col("steady")).alias("any_flip"))
    mean = lambda x: F.round(F.avg(x), 6)
    right = lambda base, now: F.sum(F.when((F.col("base_right") == base) & (F.col("pass_right") == now), 1).otherwise(0))
    sums = z.groupBy("area").agg(
        mean("agree").alias("agreement"), mean("dp").alias("mean_dp"), mean("tv").alias("mean_tv"), mean("base_right").alias("accuracy_base"), mean("pass_right").alias("accuracy_passes"),
        *(mean(F.when(F.col("rep") == i, F.col("pass_right"))).alias(f"accuracy_pass{i}") for i in (1, 2)), right(1, 0).alias("right_to_wrong"), right(0, 1).alias("wrong_to_right"))
    out = sums.join(flips.withColumn("any_flip", F.round("any_flip", 6)), "area")
    for x in ("dp", "tv"):
        p95 = nearest_rank(z, "area", F.col(x), "least(n - 1, cast(floor(0.95 * n) as bigint))")
        out = out.join(p95.select("area", F.round("value", 6).alias(f"p95_{x}")), "area")
    return out.select("area", "agreement", "any_flip", "mean_dp", "p95_dp", "mean_tv", "p95_tv", "accuracy_base", "accuracy_passes", "accuracy_pass1", "accuracy_pass2", "right_to_wrong", "wrong_to_right")


@plan("A18_p95_nearest_rank")
def p95(d):
    return f"""WITH {reads(d)}, o AS (SELECT type, conf, row_number() OVER (PARTITION BY type ORDER BY conf) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM rd)
    SELECT type, round(conf, 6) AS p95 FROM o WHERE i = least(n - 1, {d.int('0.95 * n')})"""


@plan("A19_linear_quantile")
def linear_quantile(d):
    return f"""WITH {reads(d)} SELECT type, round({d.quantile('conf', '0.025')}, 6) AS low, round({d.quantile('conf', '0.975')}, 6) AS high FROM rd GROUP BY type"""


@plan("A20_binary_metrics")
def binary_metrics(d):
    return f"""WITH {reads(d)}, b AS (SELECT subset, p, CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END AS yes, label * 1e0 AS truth FROM rk WHERE type = 'noul' AND k = 1 AND rep = 0)
    SELECT subset, round(avg(CASE WHEN yes = truth THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(greatest(avg(truth), 1 - avg(truth)), 6) AS majority, round(avg(yes), 6) AS predicted, round(avg(truth), 6) AS human,
    round(avg(CASE WHEN truth = 0 THEN yes END), 6) AS false_alarm, round(avg(CASE WHEN truth = 1 THEN 1 - yes END), 6) AS miss, round(avg((p - truth) * (p - truth)), 6) AS brier FROM b GROUP BY subset"""


@plan("A21_share_metrics")
def share_metrics(d):
    """Share of annotators: five synthetic votes."""
    return f"""WITH {reads(d)}, v AS (SELECT id, p, {d.h8(f"'v|' || {d.s('id')}")} % 6 / 5.0 AS share FROM rk WHERE type = 'noul' AND k = 1 AND rep = 0)
    SELECT count(*) AS n, round(avg(abs(p - share)), 6) AS mae, round(avg((p - share) * (p - share)), 6) AS brier, round(avg(CASE WHEN share > 0.3 AND share < 0.7 THEN CASE WHEN (p >= 0.5) = (share >= 0.5) THEN 1e0 ELSE 0e0 END END), 6) AS close_call_accuracy FROM v"""


@plan("A22_panel_mean")
def panel_mean(d):
    """Mean of the members over the questions that all three answered with confidence."""
    return f"""WITH {reads(d)} SELECT id, qid, round(avg(plabel), 6) AS p FROM rd WHERE conf >= 0.45 GROUP BY id, qid HAVING count(*) = 3"""


@plan("A23_pairwise_agreement")
def pairwise_agreement(d):
    return f"""WITH {reads(d)} SELECT a.rep AS a, b.rep AS b, count(*) AS n, round(avg(CASE WHEN a.pick = b.pick THEN 1e0 ELSE 0e0 END), 6) AS agreement
    FROM rd a JOIN rd b ON a.id = b.id AND a.qid = b.qid AND a.rep < b.rep GROUP BY a.rep, b.rep"""


@plan("A24_confusion_by_group")
def confusion(d):
    """Groups overlap: overall, by subset, by family."""
    return f"""WITH {reads(d)}, g AS (SELECT {d.each(d.arr("'overall'", "'subset:' || subset", "'fam:' || fam"))} AS grp, pick, label FROM rd WHERE type = 'noul' AND rep = 0),
    c AS (SELECT grp, count(*) FILTER (WHERE pick = 1 AND label = 1) AS tp, count(*) FILTER (WHERE pick = 1 AND label = 0) AS fp, count(*) FILTER (WHERE pick = 0 AND label = 1) AS fn, count(*) FILTER (WHERE pick = 0 AND label = 0) AS tn FROM g GROUP BY grp)
    SELECT *, round({d.double('tp')} / nullif(tp + fp, 0), 6) AS prec, round({d.double('tp')} / nullif(tp + fn, 0), 6) AS recall, round({d.double('tn')} / nullif(tn + fp, 0), 6) AS specificity,
    round(({d.double('tp')} / nullif(tp + fn, 0) + {d.double('tn')} / nullif(tn + fp, 0)) / 2, 6) AS balanced FROM c"""


@plan("A25_macro_accuracy")
def macro_accuracy(d):
    return f"""WITH {reads(d)}, g AS (SELECT type, label, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc FROM rd WHERE rep = 0 GROUP BY type, label) SELECT type, round(avg(acc), 6) AS macro FROM g GROUP BY type"""


@plan("A26_headline")
def headline(d):
    """Macro over components; the English subset stands for a public suite that counts once."""
    return f"""WITH {reads(d)}, g AS (SELECT CASE WHEN subset = 'en' THEN 'public' ELSE subset || '/' || type END AS component, CASE WHEN pick = label THEN 1e0 ELSE 0e0 END AS hit FROM rd WHERE rep = 0),
    c AS (SELECT component, avg(hit) AS acc FROM g GROUP BY component) SELECT count(*) AS components, round(100 * avg(acc), 4) AS headline FROM c"""


@plan("A27_pooled_accuracy")
def pooled(d):
    """Null unless every set is there."""
    return f"""WITH {reads(d)}, g AS (SELECT subset, count(*) AS n, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc FROM rd WHERE rep = 0 AND type = 'noul' GROUP BY subset)
    SELECT CASE WHEN count(DISTINCT subset) = 4 THEN round(sum(acc * n) / sum(n), 6) END AS pooled FROM g"""


@plan("A28_area_index")
def area_index(d):
    """Chance-corrected accuracy by area (type), weighted, with the public part at 0.4."""
    return f"""WITH {reads(d)}, g AS (SELECT type, CASE WHEN subset = 'en' THEN 'public' ELSE 'private' END AS half, avg((CASE WHEN pick = label THEN 1e0 ELSE 0e0 END - 1e0 / nk) / (1 - 1e0 / nk)) AS score FROM rd WHERE rep = 0 GROUP BY type, CASE WHEN subset = 'en' THEN 'public' ELSE 'private' END),
    a AS (SELECT type, sum(score * CASE half WHEN 'public' THEN 0.4 ELSE 0.6 END) AS area FROM g GROUP BY type)
    SELECT round(100 * sum(area * CASE type WHEN 'choice' THEN 0.5 WHEN 'noul' THEN 0.3 ELSE 0.2 END), 4) AS area_index FROM a"""


@plan("A29_two_seed_difference")
def two_seeds(d):
    return f"""WITH {reads(d)}, g AS (SELECT type, rep, avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END) AS acc FROM rd GROUP BY type, rep)
    SELECT coalesce(type, 'overall') AS area, round(avg(CASE WHEN rep > 0 THEN acc END) - avg(CASE WHEN rep = 0 THEN acc END), 6) AS difference FROM g GROUP BY ROLLUP (type)"""


@plan("A30_guard_decision")
def guard(d):
    """Whether the candidate (read 1) may replace the baseline (read 0): less loss by the bootstrap of W20, its interval clear of zero, and no type of question worse by more than 2.5 points."""
    return f"""WITH {reads(d)}, {draws(d)}, m AS (SELECT dr.replicate, sum(i.baseline - i.candidate) / sum(i.n) AS gain FROM dr JOIN i ON dr.stratum = i.stratum AND dr.slot = i.slot GROUP BY dr.replicate),
    c AS (SELECT {d.quantile('gain', '0.025')} AS low, {d.quantile('gain', '0.975')} AS high FROM m), o AS (SELECT sum(baseline - candidate) / sum(n) AS gain FROM i),
    a AS (SELECT max(loss) AS worst FROM (SELECT type, 100 * (avg(CASE WHEN rep = 1 THEN brier END) - avg(CASE WHEN rep = 0 THEN brier END)) AS loss FROM rd GROUP BY type) x)
    SELECT round(gain, 6) AS gain, round(low, 5) AS low, round(high, 5) AS high, round(worst, 4) AS worst_loss, gain > 0 AS better, low > 0 AS clear, gain > 0 AND low > 0 AND worst <= 2.5 AS accepted FROM o CROSS JOIN c CROSS JOIN a"""


@plan("A31_results_coverage")
def coverage(d):
    """Runs are orders, results their shipped lines; one failed line fails the whole group, here the customer."""
    return """WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS grp, o_orderstatus AS status FROM orders), x AS (SELECT grp, bool_or(status <> 'F') AS failed, count(*) AS n FROM r GROUP BY grp),
    m AS (SELECT count(*) AS missing FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey))
    SELECT count(*) AS groups_seen, count(*) FILTER (WHERE failed) AS groups_failed, sum(n) AS runs, max(missing) AS missing FROM x, m"""


@plan("A32_share_buckets")
def share_buckets(d):
    return f"""WITH v AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) AS share, count(*) AS votes FROM events GROUP BY user_id)
    SELECT CASE WHEN share < 0.1 THEN 'low' WHEN share < 0.3 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, sum(votes) AS votes FROM v GROUP BY CASE WHEN share < 0.1 THEN 'low' WHEN share < 0.3 THEN 'mid' ELSE 'high' END"""


@plan("A33_label_position")
def label_position(d):
    return f"""WITH {reads(d)} SELECT type, nk AS options, label AS position, count(*) AS n FROM ql GROUP BY type, nk, label"""


@plan("A34_teacher_agreement")
def teacher_agreement(d):
    return f"""WITH {reads(d)} SELECT a.type, count(*) AS both, sum(CASE WHEN a.pick = b.pick THEN 1 ELSE 0 END) AS agree, round(avg((a.conf + b.conf) / 2), 6) AS mean_top
    FROM rd a JOIN rd b ON a.id = b.id AND a.qid = b.qid AND a.rep = 0 AND b.rep = 1 GROUP BY a.type"""


@plan("A35_word_length_stats")
def word_lengths(d):
    return f"""WITH w AS (SELECT source, {d.size(d.words('text', '[^ \\t\\n\\r]+'))} AS n FROM documents)
    SELECT source, round(avg(n), 4) AS mean_words, {d.quantile('n', '0.5')} AS median_words, min(n) AS least, max(n) AS most FROM w GROUP BY source"""


@plan("A36_manifest")
def manifest(d):
    """Content hash, bytes and rows by source, whatever the row order."""
    return f"""WITH r AS (SELECT source, {d.sha(f"{d.s('doc_id')} || '|' || text")} AS h, {d.chars('text')} AS c FROM documents)
    SELECT source, count(*) AS n, sum(c) AS chars, {d.sha(d.join(d.collect('h', 'h'), ''))} AS digest FROM r GROUP BY source"""


@plan("A37_merge_check")
def merge_check(d):
    return f"""WITH {reads(d)}, m AS (SELECT a.id, a.qid, max(abs(a.p - b.p)) AS delta FROM rk a JOIN rk b ON a.id = b.id AND a.qid = b.qid AND a.k = b.k AND a.rep = 0 AND b.rep = 1 GROUP BY a.id, a.qid)
    SELECT count(*) AS n, sum(CASE WHEN x.pick = y.pick THEN 1 ELSE 0 END) AS agree, round(max(delta), 6) AS max_delta, sum(CASE WHEN x.pick <> y.pick AND x.conf >= 0.6 THEN 1 ELSE 0 END) AS clear_flips
    FROM m JOIN rd x ON m.id = x.id AND m.qid = x.qid AND x.rep = 0 JOIN rd y ON m.id = y.id AND m.qid = y.qid AND y.rep = 1"""


@plan("A39_tier_table")
def tiers(d):
    return f"""WITH {reads(d)}, x AS (SELECT fam, subset, CASE WHEN pick = label THEN 1 ELSE 0 END AS hit, 1 - plabel AS tvd FROM rd WHERE rep = 0)
    SELECT coalesce(fam, '*') AS fam, coalesce(subset, '*') AS tier, sum(hit) AS k, count(*) AS n, round(avg(tvd), 6) AS mean_tvd FROM x GROUP BY GROUPING SETS ((fam), (subset), ())"""


@plan("A40_effective_count")
def effective(d):
    return f"""WITH {reads(d)}, c AS (SELECT fam, count(*) FILTER (WHERE type = 'choice') AS choice, count(*) FILTER (WHERE type = 'noul' AND label = 1) AS yes, count(*) FILTER (WHERE type = 'noul' AND label = 0) AS no FROM ql GROUP BY fam)
    SELECT fam, choice + least(yes, no) + least(greatest(yes, no), {d.int('1.5 * least(yes, no)')}) AS effective FROM c"""


@plan("A41_run_status")
def run_status(d):
    """Orders as runs, their lines as stages."""
    return f"""WITH s AS (SELECT l_orderkey AS run, l_linenumber AS stage, CASE l_linestatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS state, {d.double('l_quantity')} AS minutes FROM lineitem)
    SELECT run, CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_and(state = 'done') THEN 'complete' ELSE 'partial' END AS status, count(*) FILTER (WHERE state = 'done') AS done, round(sum(minutes), 4) AS minutes FROM s GROUP BY run"""


@plan("M04_calibrated_softmax")
def calibrated_softmax(d):
    """Temperatures by type over log weights, shifted by the largest."""
    return f"""WITH {reads(d)}, t AS (SELECT *, ln(p) / CASE type WHEN 'choice' THEN 1.3 WHEN 'noul' THEN 0.8 ELSE 2.0 END AS z FROM rk WHERE rep = 0),
    e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY id, qid)) AS x FROM t) SELECT id, qid, k, round(x / sum(x) OVER (PARTITION BY id, qid), 6) AS p FROM e"""


@plan("M07_answer_shape")
def answer_shape(d):
    return f"""WITH {reads(d)} SELECT id, qid, type, CASE type WHEN 'choice' THEN 'option_' || {d.s('pick')} WHEN 'noul' THEN CASE WHEN pick = 1 THEN 'true' ELSE 'false' END ELSE {d.s('pick')} END AS answer,
    CASE WHEN type = 'score' THEN round(expected, 6) END AS expected, round((nk * conf - 1) / (nk - 1), 6) AS confidence FROM rd WHERE rep = 0"""


@plan("M08_two_order_mean")
def two_order(d):
    """Normalised geometric mean of the two orders where the forward read is below 0.7."""
    return f"""WITH {reads(d)}, j AS (SELECT a.id, a.qid, a.k, a.p AS p, exp((ln(a.p) + ln(b.p)) / 2) AS g, max(a.p) OVER (PARTITION BY a.id, a.qid) AS top FROM rk a JOIN rk b ON a.id = b.id AND a.qid = b.qid AND a.k = b.k AND a.rep = 0 AND b.rep = 2)
    SELECT id, qid, k, round(CASE WHEN top < 0.7 THEN g / sum(g) OVER (PARTITION BY id, qid) ELSE p END, 6) AS p FROM j"""


@plan("M09_teacher_mean")
def teacher_mean(d):
    return f"""WITH {reads(d)}, m AS (SELECT id, qid, k, avg(p) AS p FROM rk WHERE rep < 2 GROUP BY id, qid, k) SELECT id, qid, k, round(p / sum(p) OVER (PARTITION BY id, qid), 6) AS p FROM m"""


@plan("M10_relabel")
def relabel(d):
    return f"""WITH {reads(d)}, j AS (SELECT a.fam, a.type, a.id, a.qid, max_by(a.k, a.p) AS old_pick, max_by(b.k, b.p) AS new_pick, sum(abs(a.p - b.p)) AS diff FROM rk a JOIN rk b ON a.id = b.id AND a.qid = b.qid AND a.k = b.k AND a.rep = 0 AND b.rep = 1 GROUP BY a.fam, a.type, a.id, a.qid)
    SELECT fam, type, count(*) AS n, sum(CASE WHEN old_pick = new_pick THEN 1 ELSE 0 END) AS same, round(avg(diff), 6) AS mean_diff FROM j GROUP BY fam, type"""


@plan("M17_selective_bands")
def bands(d):
    return f"""WITH {reads(d)}, b AS (SELECT CASE WHEN conf >= 0.9 THEN 'act' WHEN conf >= 0.6 THEN 'confirm' ELSE 'escalate' END AS band, CASE WHEN pick = label THEN 1e0 ELSE 0e0 END AS hit FROM rd WHERE rep = 0)
    SELECT band, count(*) AS n, round(avg(hit), 6) AS accuracy FROM b GROUP BY band"""


@plan("M18_golden_tolerance")
def golden(d):
    return f"""WITH {reads(d)} SELECT a.type, count(*) AS n, sum(CASE WHEN abs(a.p - b.p) <= 0.03 THEN 1 ELSE 0 END) AS within FROM rk a JOIN rk b ON a.id = b.id AND a.qid = b.qid AND a.k = b.k AND a.rep = 0 AND b.rep = 1 GROUP BY a.type"""

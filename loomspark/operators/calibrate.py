"""Temperature fit: a grid, then golden-section search on the logarithm of the temperature, for all groups at once.

Losses are means over all rows, so each pass is one aggregate of a few numbers for each group; rows are written once and read by
every pass.  A search step depends on the one before, but only through a comparison: a pass takes in the losses of all points
that the next AHEAD steps may ask for, and the driver then walks these steps for each group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..plans.dialect import DUCK, SPARK, run
from ..plans.reads import reads
from .registry import query

LOW, HIGH, GRID, STEPS, AHEAD = math.log(0.05), math.log(20.0), 200, 60, 5
PHI = (math.sqrt(5) - 1) / 2
TOLERANCE = 1e-5


def inner(a: float, b: float) -> tuple[float, float]:
    return b - PHI * (b - a), a + PHI * (b - a)


def ahead(a: float, b: float, steps: int) -> list[float]:
    """Points that the next steps from bracket a, b may compare."""
    if not steps:
        return []
    c, d = inner(a, b)
    return [c, d, *ahead(a, d, steps - 1), *ahead(c, b, steps - 1)]


def refuse(rows: DataFrame) -> None:
    """ValueError where a logit or target isn't finite, or targets are no distribution over the row's logits."""
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate("target", F.lit(0.0), lambda s, x: s + x)
    good = finite("z") & finite("target")
    normal = (F.size("z") > 0) & (F.size("z") == F.size("target")) & F.forall("target", lambda x: x >= 0) & (F.abs(total - 1) <= TOLERANCE)
    r = rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("odd"), F.count_if(~F.coalesce(normal, F.lit(False))).alias("off")).first()
    if r["odd"]:
        raise ValueError(f"{r['odd']} rows have logits or targets that aren't finite")
    if r["off"]:
        raise ValueError(f"{r['off']} rows have targets that are no distribution")


def losses(rows: DataFrame, points: dict[str, list[float]]) -> dict[str, list[float]]:
    """Mean negative log likelihood of each group at each of its points (logarithms of temperatures); all groups have as many."""
    temperatures = {g: [math.exp(x) for x in p] for g, p in points.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each group and point of what a partition holds."""
        total = {g: np.zeros(len(t)) for g, t in temperatures.items()}
        count = dict.fromkeys(temperatures, 0)
        for b in batches:
            for (g, _), part in b.groupby(["group", b["z"].map(len)]):
                if g not in temperatures:
                    continue
                z, target = np.stack(part["z"].to_numpy()), np.stack(part["target"].to_numpy())
                z = z - z.max(axis=1, keepdims=True)
                # -sum target * (z / t - top / t - log partition): the targets add up to one only nearly, so they are kept apart
                dot, all_ = np.where(target == 0, 0.0, target * z).sum(axis=1), target.sum(axis=1)
                total[g] += [float((all_ * np.log(np.exp(z / t).sum(axis=1)) - dot / t).sum()) for t in temperatures[g]]
                count[g] += len(part)
        for g, n in count.items():
            if n:
                yield pd.DataFrame({"group": g, "at": range(len(total[g])), "loss": total[g], "n": n})

    out: dict[str, list[float]] = {g: [0.0] * len(p) for g, p in points.items()}
    for r in rows.mapInPandas(sums, "group string, at int, loss double, n long").groupBy("group", "at").agg((F.sum("loss") / F.sum("n")).alias("loss")).collect():
        out[r["group"]][r["at"]] = r["loss"]
    return out


def search(f: Callable[[dict[str, list[float]]], dict[str, list[float]]], groups: list[str]) -> dict[str, float]:
    """Logarithm of the best temperature of each group; f gives the losses at given points."""
    grid = [LOW + (HIGH - LOW) * i / GRID for i in range(GRID + 1)]
    found = f(dict.fromkeys(groups, grid))
    best = {g: grid[min(range(GRID + 1), key=found[g].__getitem__)] for g in groups}
    width = (HIGH - LOW) / GRID
    bracket = {g: (max(LOW, x - width), min(HIGH, x + width)) for g, x in best.items()}
    for done in range(0, STEPS, AHEAD):
        steps = min(AHEAD, STEPS - done)
        points = {g: ahead(*bracket[g], steps) for g in groups}
        found = f(points)
        for g in groups:
            at = dict(zip(points[g], found[g], strict=True))
            a, b = bracket[g]
            for _ in range(steps):
                c, d = inner(a, b)
                a, b = (a, d) if at[c] < at[d] else (c, b)
            bracket[g] = (a, b)
    return {g: (a + b) / 2 for g, (a, b) in bracket.items()}


def fit_temperatures(rows: DataFrame) -> DataFrame:
    """group, temperature, before and after (mean loss at 1 and at the temperature) and n, of rows (group, z, target).

    z: logits, target: a distribution over them, arrays of doubles.  Rows with a null, NaN or infinite value, or targets that are
    negative or don't add up to one, are refused: ValueError.  A null group is left out; groups are few (a row each on the driver).
    No rows: no rows out.  Losses that tie go to the lower point of the grid, and to the upper side in a step.
    """
    rows = cut(rows.where(F.col("group").isNotNull()).select("group", "z", "target"))
    refuse(rows)
    counts = {r["group"]: r["count"] for r in rows.groupBy("group").count().collect()}
    schema = "group string, temperature double, before double, after double, n long"
    if not counts:
        return rows.sparkSession.createDataFrame([], schema)
    best = search(lambda points: losses(rows, points), sorted(counts))
    ends = losses(rows, {g: [0.0, x] for g, x in best.items()})
    return rows.sparkSession.createDataFrame([(g, math.exp(x), *ends[g], counts[g]) for g, x in best.items()], schema)


def hard(d, where: str = "rep = 0") -> str:
    """CTEs after reads: h, a row for each read with its logits, and one-hot targets for its label."""
    k = lambda x: d.collect(x, "k")
    return f"{reads(d)}, h AS (SELECT id, qid, rep, type, label, {k('ln(p)')} AS z, {k('CASE WHEN k = label THEN 1e0 ELSE 0e0 END')} AS target FROM rk WHERE {where} GROUP BY id, qid, rep, type, label)"


def fit_sql(d) -> str:
    """The search in SQL: the grid, then one recursion for each step."""
    loss = lambda t: f"avg(ln({d.total(d.map('z', 'x', f'exp(x / {t})'))}) - z[label + 1] / {t})"
    c, e = f"b - {PHI!r} * (b - a)", f"a + {PHI!r} * (b - a)"
    return f"""WITH RECURSIVE {hard(d)}, g AS (SELECT unnest(generate_series(0, {GRID})) AS i), l AS MATERIALIZED (SELECT type, i, {loss(f'exp({LOW!r} + i * {HIGH - LOW!r} / {GRID})')} AS loss FROM h CROSS JOIN g GROUP BY type, i),
    best AS (SELECT type, min(i) AS i FROM (SELECT *, min(loss) OVER (PARTITION BY type) AS least FROM l) x WHERE loss = least GROUP BY type),
    s AS (SELECT 0 AS step, type, greatest({LOW!r}, {LOW!r} + (i - 1) * {HIGH - LOW!r} / {GRID}) AS a, least({HIGH!r}, {LOW!r} + (i + 1) * {HIGH - LOW!r} / {GRID}) AS b FROM best
      UNION ALL SELECT step + 1, type, CASE WHEN lc < le THEN a ELSE {c} END, CASE WHEN lc < le THEN {e} ELSE b END FROM (SELECT s.step, s.type, s.a, s.b, {loss(f'exp({c})')} AS lc, {loss(f'exp({e})')} AS le FROM s JOIN h ON h.type = s.type WHERE s.step < {STEPS} GROUP BY s.step, s.type, s.a, s.b) x),
    t AS (SELECT type, exp((a + b) / 2) AS t FROM s WHERE step = {STEPS})"""


@query("M05_temperature_grid", f"{fit_sql(DUCK)} SELECT h.type, round(t, 5) AS temperature, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1]), 6) AS before, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x / t)))) - z[label + 1] / t), 6) AS after, count(*) AS n FROM h JOIN t ON h.type = t.type GROUP BY h.type, t")
def fit(spark, sf_dir):
    """One temperature for each type of question, against the labels, over all records: 201 points of a grid, then 60 steps."""
    rows = run(spark, sf_dir, f"WITH {hard(SPARK)} SELECT type AS group, z, target FROM h")
    return fit_temperatures(rows).select(F.col("group").alias("type"), F.round("temperature", 5).alias("temperature"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "n")


def effect_sql(d, temperatures: str) -> str:
    """ECE and hits before and after; ``temperatures`` is a CTE t (type, t) in place, or a table of that name."""
    conf = d.int(d.half_even("100 * conf") + " / 10")
    return f"""{temperatures}, e AS (SELECT rk.*, exp(ln(p) / t) AS x FROM rk JOIN t ON rk.type = t.type), c AS (SELECT id, qid, rep, label, max(p) AS before_p, max(x) / sum(x) AS after_p, max_by(k, p) AS pick0, max_by(k, x) AS pick1 FROM e GROUP BY id, qid, rep, label),
    u AS (SELECT 'before' AS at_time, before_p AS conf, pick0 AS pick, label FROM c UNION ALL SELECT 'after', after_p, pick1, label FROM c),
    b AS (SELECT at_time, least(9, {conf}) AS bin, count(*) AS n, sum(CASE WHEN pick = label THEN 1 ELSE 0 END) AS hits, abs(avg(conf) - avg(CASE WHEN pick = label THEN 1e0 ELSE 0e0 END)) AS gap FROM u GROUP BY at_time, least(9, {conf}))
    SELECT at_time, round(sum(n * gap) / sum(n), 5) AS ece, sum(hits) AS hits FROM b GROUP BY at_time"""


@query("A38_M06_calibration_effect", effect_sql(DUCK, fit_sql(DUCK)))
def effect(spark, sf_dir):
    """ECE before and after the fitted temperatures; the picks, and so accuracy, must not change."""
    fitted = fit_temperatures(run(spark, sf_dir, f"WITH {hard(SPARK)} SELECT type AS group, z, target FROM h")).collect()
    rows = ", ".join(f"('{r['group']}', {r['temperature']!r}D)" for r in fitted) or "(CAST(NULL AS STRING), 1D)"
    return run(spark, sf_dir, effect_sql(SPARK, f"WITH {reads(SPARK)}, t AS (SELECT * FROM VALUES {rows} AS v(type, t))"))

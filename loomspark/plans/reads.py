"""Synthetic questions and reads over ``documents``, the same in every engine: weights are hash digits, not random numbers.

Each document asks three questions: c, a choice of four; n, yes or no (1, 0); s, a score from 0 to 4.  Each is read three
times; the third with options in another order.
"""

from __future__ import annotations


def questions(d) -> str:
    return f"""qs AS (SELECT id, fam, subset, qid, CASE qid WHEN 'c' THEN 'choice' WHEN 'n' THEN 'noul' ELSE 'score' END AS type,
      CASE qid WHEN 'c' THEN 4 WHEN 'n' THEN 2 ELSE 5 END AS nk
    FROM (SELECT doc_id AS id, source AS fam, lang AS subset, {d.each(d.arr("'c'", "'n'", "'s'"))} AS qid FROM documents) q0),
    ql AS (SELECT *, {d.h8(f"'l|' || {d.s('id')} || '|' || qid")} % nk AS label FROM qs)"""


def reads(d) -> str:
    """CTEs: rk, a row for each key of each read; rd, a row for each read."""
    return f"""{questions(d)},
    r0 AS (SELECT *, {d.each(d.arr('0', '1', '2'))} AS rep FROM ql),
    r1 AS (SELECT *, {d.each(d.seq('0', 'nk - 1'))} AS k FROM r0),
    rw AS (SELECT *, 1 + {d.h8(f"'r|' || {d.s('id')} || '|' || qid || '|' || {d.s('rep')} || '|' || {d.s('k')}")} + CASE WHEN k = label THEN 3000000000 ELSE 0 END AS w FROM r1),
    rk AS (SELECT id, fam, subset, qid, type, nk, label, rep, CASE WHEN rep = 2 THEN 1 ELSE 0 END AS order_seed, k,
      {d.double('w')} / {d.double('sum(w) OVER (PARTITION BY id, qid, rep)')} AS p FROM rw),
    rc AS (SELECT *, sum(p) OVER (PARTITION BY id, qid, rep ORDER BY k) AS cp, CASE WHEN k >= label THEN 1.0 ELSE 0.0 END AS cl FROM rk),
    rd AS (SELECT id, fam, subset, qid, type, nk, label, rep, order_seed, max_by(k, p) AS pick, max(p) AS conf,
      max(CASE WHEN k = label THEN p END) AS plabel, sum((p - CASE WHEN k = label THEN 1 ELSE 0 END) * (p - CASE WHEN k = label THEN 1 ELSE 0 END)) AS brier,
      sum(k * p) AS expected, sum((cp - cl) * (cp - cl)) / (nk - 1) AS rps
    FROM rc GROUP BY id, fam, subset, qid, type, nk, label, rep, order_seed)"""


def draws(d) -> str:
    """CTEs after ``reads``: i, the groups of each stratum with their loss in both runs; dr, 2000 replicates that each draw as many
    groups of a stratum as it has, by hash."""
    return f"""g AS (SELECT subset AS stratum, fam || '/' || subset AS grp, sum(CASE WHEN rep = 0 THEN brier ELSE 0 END) AS baseline, sum(CASE WHEN rep = 1 THEN brier ELSE 0 END) AS candidate, count(*) / 2 AS n FROM rd WHERE rep < 2 GROUP BY subset, fam || '/' || subset),
    i AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY grp) - 1 AS slot, count(*) OVER (PARTITION BY stratum) AS k FROM g), b AS (SELECT {d.each(d.seq('1', '2000'))} AS replicate),
    dr AS (SELECT b.replicate, i.stratum, {d.h8(f"'7|' || {d.s('b.replicate')} || '|' || i.stratum || '|' || {d.s('i.slot')}")} % i.k AS slot FROM i CROSS JOIN b)"""

"""Records and questions: conversion, validation, filters, joins, world oracles, the wire contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.reads import draws, questions, reads
from .registry import plan, query


def record(d) -> str:
    """CTE rec: documents as records with a JSON state and question text."""
    return f"""rec AS (SELECT doc_id AS id, source, lang, n_chars, text, '{{"b":' || {d.s('n_chars')} || ',"a":"' || lang || '","q":{{"type":"choice","instructions":"Pick one"}}}}' AS state FROM documents)"""


@plan("P01_explode_questions")
def explode_questions(d):
    return f"WITH {questions(d)} SELECT id, qid, type, row_number() OVER (PARTITION BY id ORDER BY qid) AS ord FROM ql"


@plan("P02_wire_question")
def wire_question(d):
    """Three fields; the options of a choice with empty descriptions."""
    opts = d.join(d.map(d.seq("0", "nk - 1"), "k", f"'option_' || {d.s('k')} || ':null'"), ",")
    return f"WITH {questions(d)} SELECT id, qid, type, 'About ' || fam AS instructions, CASE WHEN type = 'choice' THEN {opts} WHEN type = 'score' THEN {d.join(d.map(d.seq('0', 'nk - 1'), 'k', 'chr(97 + cast(k as int))'), ',')} END AS criteria FROM ql"


@plan("P03_P04_label_key")
def label_key(d):
    return f"WITH {questions(d)} SELECT id, qid, CASE type WHEN 'choice' THEN 'option_' || {d.s('label')} WHEN 'noul' THEN CASE WHEN label = 1 THEN 'true' ELSE 'false' END ELSE {d.s('label')} END AS label_key FROM ql"


@plan("P05_ordered_keys")
def ordered_keys(d):
    return f"WITH {questions(d)} SELECT id, qid, CASE type WHEN 'noul' THEN 'true,false' ELSE {d.join(d.map(d.seq('0', 'nk - 1'), 'k', d.s('k')), ',')} END AS keys FROM ql"


@plan("P06_permute_options")
def permute(d):
    """Order by rotation: the third read's options."""
    return f"WITH {questions(d)} SELECT id, qid, {d.join(d.map(d.seq('0', 'nk - 1'), 'k', d.s('(k + label) % nk')), ',')} AS keys FROM ql WHERE type = 'choice'"


@plan("P07_gold_distribution")
def gold(d):
    """Five votes normalised; the first key with the most votes."""
    return f"""WITH v AS (SELECT doc_id, {d.h8(d.s('doc_id'))} % 3 AS a, {d.h8(d.s('doc_id') + " || 'b'")} % 3 AS b, 1 + {d.h8(d.s('doc_id') + " || 'c'")} % 3 AS c FROM documents)
    SELECT doc_id, round({d.double('a')} / (a + b + c), 6) AS pa, round({d.double('b')} / (a + b + c), 6) AS pb, round({d.double('c')} / (a + b + c), 6) AS pc, {d.where_in(d.arr('a', 'b', 'c'), 'greatest(a, b, c)')} AS top FROM v"""


@plan("P08_mean_to_level")
def mean_to_level(d):
    return f"SELECT user_id, least(4, greatest(0, {d.int('avg(value) / 20 + 0.5')} - 1)) AS level FROM events GROUP BY user_id"


@plan("P09_smoothed_target")
def smoothed(d):
    return f"WITH {questions(d)} SELECT id, CASE WHEN label = 1 THEN 0.95 ELSE 0.05 END AS p_true, CASE WHEN label = 1 THEN 0.05 ELSE 0.95 END AS p_false FROM ql WHERE type = 'noul'"


@plan("P10_ordinal_kernel")
def ordinal(d):
    return f"""WITH {questions(d)}, k AS (SELECT id, nk, label, {d.each(d.seq('0', 'nk - 1'))} AS i FROM ql WHERE type = 'score'), w AS (SELECT *, power(0.4, (i - label) * (i - label)) AS w FROM k) SELECT id, i, round(w / sum(w) OVER (PARTITION BY id), 6) AS p FROM w"""


@plan("P11_training_target")
def target(d):
    """Score: ordinal; noul: soft; choice: one-hot."""
    return f"""WITH {questions(d)}, k AS (SELECT *, {d.each(d.seq('0', 'nk - 1'))} AS i FROM ql), w AS (SELECT *, CASE type WHEN 'score' THEN power(0.4, (i - label) * (i - label)) WHEN 'noul' THEN CASE WHEN i = label THEN 0.95e0 ELSE 0.05e0 END ELSE CASE WHEN i = label THEN 1e0 ELSE 0e0 END END AS w FROM k)
    SELECT id, qid, i, round(w / sum(w) OVER (PARTITION BY id, qid), 6) AS p FROM w"""


@plan("P12_truthy_coalesce")
def truthy(d):
    """Empty strings count as missing."""
    return f"SELECT doc_id, coalesce(nullif({d.extract('text', '([0-9]{4,})', 1)}, ''), nullif(source, ''), lang) AS family FROM documents"


@plan("P15_forbidden_keys")
def forbidden_keys(d):
    return f"""WITH {record(d)}, x AS (SELECT id, CASE WHEN id % 7 = 0 THEN '{{"label":1,"x":' || state || '}}' ELSE state END AS t FROM rec) SELECT id FROM x WHERE {d.like('t', '"(label|gold|answer)" *:')}"""


@plan("P16_sanitise_dashes")
def dashes(d):
    return "SELECT item_id, replace(replace(text || ' – — x', '—', '-'), '–', '-') AS text FROM benchmark"


@plan("P17_lenient_json")
def lenient_json(d):
    """Fenced or surrounded by talk: the outermost braces."""
    return f"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Sure! {{"a": ' || {d.s('n_chars')} || '}} done' WHEN 1 THEN '```json {{"a": ' || {d.s('n_chars')} || '}} ```' ELSE '{{"a": ' || {d.s('n_chars')} || '}}' END AS t FROM documents), y AS (SELECT doc_id, {d.extract('t', '([{].*[}])', 1)} AS j FROM x) SELECT doc_id, {d.json('j', '$.a')} AS a FROM y"""


@plan("P18_drop_question")
def drop_question(d):
    return f"WITH {questions(d)}, bad AS (SELECT id, qid FROM ql WHERE label = 0 AND qid = 's') SELECT ql.id, ql.qid FROM ql LEFT JOIN bad ON ql.id = bad.id AND ql.qid = bad.qid WHERE bad.id IS NULL"


@plan("P19_excerpt_islands")
def excerpt(d):
    """Turns of an assistant with their neighbours, merged where they touch."""
    return f"""WITH h AS (SELECT conv_id, {d.each('nb')} AS turn FROM (SELECT conv_id, {d.arr('turn - 1', 'turn', 'turn + 1')} AS nb FROM conversations WHERE role = 'assistant' AND turn % 3 = 1) a), u AS (SELECT DISTINCT h.conv_id, h.turn FROM h JOIN conversations c ON h.conv_id = c.conv_id AND h.turn = c.turn),
    i AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM u) SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM i GROUP BY conv_id, island"""


@plan("P21_template")
def template(d):
    return f"SELECT doc_id, 'Source: ' || source || '; language: ' || lang || '; ' || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS state FROM documents"


@plan("P22_split_composite")
def split_composite(d):
    return f"WITH x AS (SELECT item_id, 'Premise: ' || text || ' Hypothesis: ' || substr(text, 1, 20) AS t FROM benchmark) SELECT item_id, {d.extract('t', '^Premise: (.*) Hypothesis: ', 1)} AS premise, {d.extract('t', ' Hypothesis: (.*)$', 1)} AS hypothesis FROM x"


@plan("P23_rsplit_id")
def rsplit(d):
    return f"WITH x AS (SELECT source || '-' || lang || '-' || {d.s('doc_id')} AS id FROM documents) SELECT id, {d.extract('id', '^(.*)-([0-9]+)$', 1)} AS article, cast({d.extract('id', '^(.*)-([0-9]+)$', 2)} AS bigint) AS idx FROM x"


@plan("P24_inject_nonce")
def inject_nonce(d):
    """Into objects only, and only where the field is free."""
    return f"""WITH {record(d)} SELECT id, CASE WHEN {d.starts('state', "'{'")} AND NOT {d.holds('state', "'nonce'")} THEN substr(state, 1, {d.chars('state')} - 1) || ',"nonce":"' || substr({d.sha(d.s('id'))}, 1, 8) || '"}}' END AS state FROM rec"""


@plan("P26_root_source")
def root_source(d):
    return f"SELECT page_id, coalesce(nullif(lower({d.extract('url', '^https?://(?:www[.]|m[.])?([^/]+)/', 1)}), ''), 'none') AS root FROM pages"


@plan("F01_J10_source_allowlist")
def allowlist(d):
    """Exact rule, then prefix rule, else dropped with a reason."""
    return f"""WITH rules AS (SELECT 'src1' AS rule, 'keep' AS act, 0 AS prio UNION ALL SELECT 'src1*', 'keep_prefix', 1 UNION ALL SELECT 'src2*', 'drop_listed', 1),
    m AS (SELECT a.doc_id, a.source, r.act, row_number() OVER (PARTITION BY a.doc_id ORDER BY r.prio, r.rule) AS rn FROM documents a LEFT JOIN rules r ON a.source = r.rule OR (r.prio = 1 AND {d.starts('a.source', "replace(r.rule, '*', '')")}))
    SELECT source, coalesce(act, 'drop_default') AS act, count(*) AS n FROM m WHERE rn = 1 GROUP BY source, coalesce(act, 'drop_default')"""


@plan("F02_row_validity")
def validity(d):
    return "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN n_chars < 100 THEN 'short' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang' ELSE 'ok' END AS verdict FROM documents"


@plan("F03_J03_forbidden_anti")
def forbidden(d):
    return f"SELECT a.doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM labels b WHERE b.toxic = 1 AND b.doc_id = a.doc_id)"


@plan("F04_no_overlap")
def no_overlap(d):
    return f"SELECT count(*) AS overlap FROM (SELECT DISTINCT {d.sha('a.text')} AS h FROM documents a) x JOIN (SELECT DISTINCT {d.sha('b.text')} AS h FROM benchmark b) y ON x.h = y.h"


@plan("F05_token_boundary")
def boundary(d):
    return f"SELECT doc_id FROM documents WHERE {d.like('lower(text)', '(^|[^a-z0-9])(license|the)([^a-z0-9]|$)')}"


@plan("F06_licence_policy")
def licence(d):
    return f"""WITH x AS (SELECT doc_id, CASE WHEN {d.like('lower(text)', 'gnu general public')} THEN 'gpl' WHEN {d.like('lower(text)', 'cc by-nc')} THEN 'nc' WHEN {d.like('lower(text)', 'license')} THEN 'other' END AS licence FROM documents) SELECT coalesce(licence, 'none') AS licence, count(*) AS n, coalesce(licence IN ('other'), false) AS allowed FROM x GROUP BY licence"""


@plan("F07_answer_leak")
def leak(d):
    return f"SELECT doc_id FROM documents WHERE {d.like('text', '(?i)(answer|correct) *(is|:)|licensed under')}"


@plan("F08_state_leaks_option")
def state_leak(d):
    """A text field of the state (props) whose name shares a token with the question id event_type, or is one for labels, and whose value is an option."""
    key = "(^|[_-])event([_-]|$)|^(targets?|reference|expected|label(s|))$"  # type is too common a token
    return f"""WITH o AS (SELECT DISTINCT lower(event_type) AS name FROM events), f AS (SELECT event_id, {d.each(d.words('props', '"[^"]+" *: *"[^"]*"'))} AS field FROM events),
    kv AS (SELECT event_id, lower({d.extract('field', '^"([^"]+)"', 1)}) AS k, lower(trim({d.extract('field', ': *"([^"]*)"$', 1)})) AS v FROM f) SELECT DISTINCT event_id FROM kv WHERE {d.like('k', key)} AND v IN (SELECT name FROM o)"""


@plan("F09_authored_validity")
def authored(d):
    """Well-formed questions; the first two of each record, if it has two or more."""
    return f"""WITH {questions(d)}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY qid) AS rn, count(*) OVER (PARTITION BY id) AS n FROM ql WHERE nk BETWEEN 2 AND 12 AND label < nk AND {d.chars('fam')} <= 90) SELECT id, qid FROM v WHERE n >= 2 AND rn <= 2"""


@plan("F10_teacher_filter")
def teacher_filter(d):
    return f"""WITH {reads(d)} SELECT a.id, a.qid FROM rd a JOIN rd b ON a.id = b.id AND a.qid = b.qid AND a.rep = 0 AND b.rep = 1 WHERE NOT (a.pick <> b.pick AND a.conf < 0.6 AND b.conf < 0.6) AND (a.conf + b.conf) / 2 >= 0.4"""


@plan("F11_record_lint")
def lint(d):
    return f"""WITH {questions(d)}, x AS (SELECT id, qid, CASE WHEN id % 11 = 0 THEN 9 ELSE label END AS label, nk, type, fam FROM ql),
    p AS (SELECT id, qid, 'label out of range' AS problem FROM x WHERE label >= nk UNION ALL SELECT id, qid, 'unknown family' FROM x WHERE fam = 'src19' UNION ALL SELECT id, qid, 'too many options' FROM x WHERE nk > 4 AND type <> 'score') SELECT problem, count(*) AS n, count(DISTINCT id) AS records FROM p GROUP BY problem"""


@plan("F12_option_cap")
def option_cap(d):
    return f"WITH {questions(d)} SELECT id, qid, nk > 4 AS over_train, nk > 255 AS over_eval FROM ql"


@plan("F16_subpopulation")
def subpopulation(d):
    return "SELECT doc_id, source FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2', 'src3')"


@plan("F17_request_validation")
def request_validation(d):
    """First failing rule."""
    return "SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN 'no state' WHEN o_totalprice IS NULL OR o_totalprice <> o_totalprice THEN 'not a number' WHEN o_totalprice < 1000 THEN 'too small' WHEN o_totalprice > 400000 THEN 'too large' ELSE 'ok' END AS message FROM orders"


@plan("F18_probability_sanitation")
def sanitation(d):
    return "SELECT event_id, CASE WHEN value IS NULL OR value = cast('NaN' as double) OR abs(value) = cast('Infinity' as double) THEN 0e0 ELSE least(1e0, greatest(0e0, value / 50)) END AS p FROM events"


@plan("F19_receipt_binding")
def receipt(d):
    """Hashes and counts of two manifests that must be equal; source src3 is changed on purpose."""
    return f"""WITH a AS (SELECT source, count(*) AS n, max({d.sha('text')}) AS h FROM documents GROUP BY source), b AS (SELECT source, count(*) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS n, max({d.sha('text')}) AS h FROM documents GROUP BY source)
    SELECT coalesce(a.source, b.source) AS source FROM a FULL OUTER JOIN b ON a.source = b.source WHERE a.n IS DISTINCT FROM b.n OR a.h IS DISTINCT FROM b.h"""


@plan("F20_temperature_sanity")
def temperature_sanity(d):
    return "SELECT event_id FROM events WHERE value IS NOT NULL AND value > 0 AND value <= 1e6"


@plan("F21_provenance_audit")
def provenance(d):
    return f"SELECT page_id, CASE WHEN NOT {d.starts('url', chr(39) + 'http' + chr(39))} THEN 'scheme' WHEN {d.like('url', 'example[.]org')} THEN 'licence' WHEN {d.like('html', '<script')} THEN 'script' ELSE 'ok' END AS verdict FROM pages"


@plan("J01_results_x_suite")
def results_suite(d):
    return """SELECT CASE WHEN o.o_orderkey IS NULL THEN 'outside' WHEN l.l_orderkey IS NULL THEN 'missing' ELSE 'both' END AS side, count(*) AS n
    FROM (SELECT DISTINCT o_orderkey FROM orders) o FULL OUTER JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey GROUP BY CASE WHEN o.o_orderkey IS NULL THEN 'outside' WHEN l.l_orderkey IS NULL THEN 'missing' ELSE 'both' END"""


@plan("J02_reads_x_questions")
def reads_questions(d):
    return f"WITH {reads(d)} SELECT rd.id, rd.qid, rd.rep, ql.label, rd.pick FROM rd JOIN ql ON rd.id = ql.id AND rd.qid = ql.qid WHERE rd.pick <> ql.label"


@plan("J04_semi_selected")
def semi(d):
    return "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"


@plan("J08_M11_pattern_match")
def pattern_match(d):
    """A proof by chained facts, with its trace: customers whose supplier shares nation and region; conflicts are ambiguous."""
    return f"""WITH p AS (SELECT o.o_orderkey AS anchor, c.c_custkey, s.s_suppkey, r.r_name, 'o' || {d.s('o.o_orderkey')} || '>c' || {d.s('c.c_custkey')} || '>n' || {d.s('n.n_nationkey')} || '>s' || {d.s('s.s_suppkey')} AS trace
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = n.n_nationkey)
    SELECT anchor, CASE WHEN count(DISTINCT s_suppkey) > 1 THEN 'ambiguous' ELSE 'supported' END AS status, min(trace) AS trace FROM p GROUP BY anchor"""


@query("J09_exhaustive_oracle", """SELECT o.o_orderkey AS anchor FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON s.s_nationkey = c.c_nationkey WHERE l.l_orderkey = o.o_orderkey AND c.c_custkey = o.o_custkey)""")
def exhaustive(spark, sf_dir):
    """The same by membership tests only: an order's customer gives the nation that one of its suppliers must have.

    Suppliers and customers meet by nation only under an order, never all of a nation's with each other.
    """
    orders, lines, suppliers, customers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "supplier", "customer"))
    nations = lines.select("l_orderkey", "l_suppkey").join(suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), "nation")
    found = orders.select("o_orderkey", "o_custkey").join(customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey").join(nations, ["o_orderkey", "nation"], "left_semi")
    return orders.join(found, ["o_orderkey", "o_custkey"], "left_semi").select(F.col("o_orderkey").alias("anchor"))


def ranked(d, table, key, out):
    """CTE of a table's keys in hash order: ranks within 4096 ranges of the hash, after the totals of the ranges before."""
    return f"""{out}_h AS (SELECT {key}, {d.sha(d.s(key))} AS h FROM {table}), {out}_n AS (SELECT substr(h, 1, 3) AS q, count(*) AS n FROM {out}_h GROUP BY substr(h, 1, 3)),
    {out}_o AS (SELECT q, sum(n) OVER (ORDER BY q) - n AS ahead FROM {out}_n), {out} AS (SELECT {key}, ahead + row_number() OVER (PARTITION BY q ORDER BY h) AS rn FROM {out}_h JOIN {out}_o ON substr(h, 1, 3) = q)"""


@plan("J11_slot_zip")
def slot_zip(d):
    """Slots are all documents, candidates all items, both in hash order; the shorter list ends the zip."""
    return f"""WITH {ranked(d, 'documents', 'doc_id', 'a')}, {ranked(d, 'benchmark', 'item_id', 'b')} SELECT a.doc_id, b.item_id FROM a JOIN b ON a.rn = b.rn"""


@plan("J12_text_ancestry")
def ancestry(d):
    return f"SELECT a.doc_id, b.item_id FROM documents a JOIN benchmark b ON {d.holds('a.text', 'b.text')}"


@plan("J13_paired_draw")
def paired_draw(d):
    """Baseline and candidate on the same draws of groups as W20_group_bootstrap, by stratum and (*) over all."""
    return f"""WITH {reads(d)}, {draws(d)} SELECT dr.replicate, coalesce(dr.stratum, '*') AS stratum, round(sum(i.baseline) / sum(i.n), 6) AS baseline, round(sum(i.candidate) / sum(i.n), 6) AS candidate, round(sum(i.candidate - i.baseline) / sum(i.n), 6) AS delta
    FROM dr JOIN i ON dr.stratum = i.stratum AND dr.slot = i.slot GROUP BY GROUPING SETS ((dr.replicate, dr.stratum), (dr.replicate))"""


@plan("J14_intersect_ids")
def intersect_ids(d):
    return f"WITH {reads(d)} SELECT id FROM rd WHERE qid = 'c' AND pick = label GROUP BY id HAVING count(*) = 3"


@plan("J15_board_diff")
def board_diff(d):
    return f"""WITH {reads(d)}, a AS (SELECT fam, count(*) FILTER (WHERE pick = label) AS v FROM rd WHERE rep = 0 AND fam <> 'src4' GROUP BY fam), b AS (SELECT fam, count(*) FILTER (WHERE pick = label) AS v FROM rd WHERE rep = 1 AND fam <> 'src5' GROUP BY fam)
    SELECT coalesce(a.fam, b.fam) AS fam, a.v AS old_value, b.v AS new_value FROM a FULL OUTER JOIN b ON a.fam = b.fam WHERE a.v IS DISTINCT FROM b.v"""


@plan("J16_row_by_position")
def by_position(d):
    return "WITH x AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, source FROM documents) SELECT doc_id, source, idx FROM x WHERE idx IN (0, 7, 13)"


@plan("J17_config_diff")
def config_diff(d):
    return """WITH a AS (SELECT 'lr' AS k, '1e-4' AS v UNION ALL SELECT 'steps', '100' UNION ALL SELECT 'seed', '1'), b AS (SELECT 'lr' AS k, '1e-4' AS v UNION ALL SELECT 'steps', '200' UNION ALL SELECT 'warmup', '5'), n AS (SELECT count(*) AS docs FROM documents)
    SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value, docs FROM a FULL OUTER JOIN b ON a.k = b.k CROSS JOIN n WHERE a.v IS DISTINCT FROM b.v"""


@plan("M01_option_names")
def option_names(d):
    """Bijective letters for options: A to Z, then AA to ZZ, AAA and so on; 0 has no name."""
    rest = ["i"]
    for _ in range(6):  # seven letters: 8 billion names
        rest.append(d.div(f"{rest[-1]} - 1", "26"))
    letters = " || ".join(f"CASE WHEN i >= {sum(26**k for k in range(at + 1))} THEN {d.from_code(f'65 + ({rest[at]} - 1) % 26')} ELSE '' END" for at in range(6, -1, -1))
    return f"""WITH n AS (SELECT p_partkey AS i FROM part) SELECT i, {letters} AS name FROM n"""


@plan("M02_prompt_render")
def prompt(d):
    return f"""WITH {questions(d)} SELECT id, qid, concat_ws(chr(10), 'STATE', fam, 'QUESTION', 'About ' || subset, 'OPTIONS', {d.join(d.map(d.seq('0', 'nk - 1'), 'k', f"chr(65 + cast(k as int)) || '. option'"), '; ')}) AS prompt FROM ql"""


@plan("M12_minimal_flip_cells")
def flip_cells(d):
    return f"""WITH {questions(d)} SELECT fam, count(DISTINCT type || '/' || {d.s('label % 2')}) AS cells, count(DISTINCT type || '/' || {d.s('label % 2')}) = 6 AS complete FROM ql GROUP BY fam"""


@plan("M16_gate")
def gate(d):
    """Composition opens only if no candidate holds a protected item whole."""
    return f"SELECT count(*) AS hits, count(*) = 0 AS open FROM documents a JOIN benchmark b ON {d.holds('a.text', 'b.text')}"


@plan("M19_type_inference")
def type_inference(d):
    return f"""WITH x AS (SELECT user_id, {d.gather('event_type')} AS opts FROM events GROUP BY user_id) SELECT user_id, CASE WHEN {d.size('opts')} = 2 THEN 'noul' WHEN {d.size('opts')} >= 5 THEN 'score' ELSE 'choice' END AS type FROM x"""


@plan("M11_tool_precedence")
def tool_precedence(d):
    """decline, then answer from context, explain, ask, call."""
    return """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'decline' WHEN o_totalprice > 300000 THEN 'answer_context' WHEN o_totalprice > 200000 THEN 'explain_unavailable' WHEN o_custkey % 5 = 0 THEN 'ask_user' ELSE 'call_tool' END AS label FROM orders"""

"""One query for each operator, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents"), n_shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import measure

    return measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_print, near_groups

    out = near_groups(table(spark, sf_dir, "documents"), k=3)
    return out.select("doc_id", hex_print("fp").alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digest

    return digest(table(spark, sf_dir, "documents"), width=35)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encoding import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "source", "lang"])
    return out.select("doc_id", "source", "lang", F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("kept"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, absorb=50)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance

    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, n=3, n_buckets=10_000, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op2_sharding, op8_quality_rules, op9_simhash, op4_substring_dedup, op1_packing, op5_bpe, op6_token_counts, op3_topk, op10_language, op7_quality_classifier, op11_phrases, op12_lm_scoring, op13_importance)}

ORACLES: dict[str, str] = {}

ORACLES["op8_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[*\x{2022}\x{25aa}\x{25cf}-]'))) AS n_bullets,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09\x0D]*$'))) AS n_ellipses FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * (n_symbols - n_bars) > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words
    OR 100 * n_letters < 50 * word_chars OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 50 * n_lines) AS kept
FROM b
"""

ORACLES["op3_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM i),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM k) WHERE c > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.r = gone.r AND words.p = gone.p WHERE gone.r IS NULL GROUP BY words.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r LEFT JOIN n ON d.r = n.r
"""

ORACLES["op11_phrases"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT row_number() OVER () AS i, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
e AS (SELECT i, lang, w, unnest(range(1, len(w) + 1)) AS j FROM w WHERE len(w) > 0),
n AS (SELECT lang, count(*) AS n FROM e GROUP BY lang),
f1 AS (SELECT lang, w[j] AS phrase, count(*) AS f FROM e GROUP BY 1, 2),
f2 AS (SELECT lang, w[j] AS x, w[j+1] AS y, count(*) AS f FROM e WHERE j < len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 10),
f3 AS (SELECT lang, w[j] AS x, w[j+1] AS y, w[j+2] AS z, count(*) AS f FROM e WHERE j + 1 < len(w) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
cuts AS (SELECT f2.lang, x || ' ' || y AS phrase, f2.f AS a, a.f AS l, b.f AS r, 1 AS k FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.phrase = x JOIN f1 b ON b.lang = f2.lang AND b.phrase = y
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, a.f, b.f, 1 FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.phrase = f3.x JOIN f2 b ON b.lang = f3.lang AND b.x = f3.y AND b.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, a.f, b.f, 2 FROM f3 JOIN f2 a ON a.lang = f3.lang AND a.x = f3.x AND a.y = f3.y JOIN f1 b ON b.lang = f3.lang AND b.phrase = f3.z),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) t WHERE o = 1),
inner2 AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) t GROUP BY 1, 2),
k AS (SELECT c.* FROM c LEFT JOIN inner2 i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * c.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

#: CRC-32 by the byte, from a table of the 256 remainders; the state of an n-gram is that of the one before, a space and a word further.
ORACLES["op13_importance"] = r"""
WITH RECURSIVE t(i, k, v) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
e AS (SELECT side, r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
b AS (SELECT word, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT word FROM e) x),
fold1 AS (SELECT word, b, list_reduce(b, lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295) AS s FROM b CROSS JOIN tab),
o AS (SELECT side, r, j, s AS s1, b FROM e JOIN fold1 USING (word)),
q AS (SELECT side, r, j, b, s1, lag(s1) OVER z AS p, lag(b) OVER z AS pb, lag(s1, 2) OVER z AS pp FROM o WINDOW z AS (PARTITION BY side, r ORDER BY j)),
g AS (SELECT side, r, j, s1, CASE WHEN p IS NOT NULL THEN list_reduce(list_prepend(32, b), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), p) END AS s2,
  CASE WHEN pp IS NOT NULL THEN list_reduce(list_concat([32], pb, [32], b), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), pp) END AS s3 FROM q CROSS JOIN tab),
f AS (SELECT side, r, xor(unnest([s1, s2, s3]), 4294967295) % 10000 AS bucket FROM g),
fb AS (SELECT side, r, bucket FROM f WHERE bucket IS NOT NULL),
n AS (SELECT range AS bucket, count(*) FILTER (WHERE side = 'd')::DOUBLE AS s, count(*) FILTER (WHERE side = 'b')::DOUBLE AS t FROM range(10000) LEFT JOIN fb ON fb.bucket = range GROUP BY range),
tot AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
gain AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (tot.s + 10000) / ((n.s + 1) * (tot.t + 10000))))::BIGINT AS g FROM n CROSS JOIN tot),
m AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
x AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM w LEFT JOIN m ON m.r = w.r WHERE side = 'd'),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT *, CASE WHEN n_words >= 20 AND doc_id IS NOT NULL THEN row_number() OVER (PARTITION BY n_words >= 20 AND doc_id IS NOT NULL ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (WHERE n_words >= 20 AND doc_id IS NOT NULL) OVER () AS able FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank FROM z
"""

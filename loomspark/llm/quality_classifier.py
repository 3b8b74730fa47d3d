"""Quality classifier by hierarchical empirical Bayes.

Document evidence.  A document can be bad in two ways: poor (quality 0) or toxic.  On a bounded sample of labelled documents,
each way's share of documents that hold a word, and the share among all others, give a log-likelihood ratio.  Words count as
signs of it if the ratio is large and the two shares differ by far more than chance has it.  A text's evidence for either way
is the sum over the signs in it.  Beside its words a text has a few words for its shape: length, repetition, capitals, marks.

Sites.  Every document of the corpus counts for its site with its posterior share of being bad.  Sites are hosts, and paths
within hosts.  The rates of hosts scatter around the global rate as a Beta distribution whose strength comes from their mean
and variance (method of moments); the rates of paths scatter around their host's in the same way.  A host's posterior rate
draws on its documents and the global prior, a path's on its documents and its host, so sparse sites stay near the level
above.  A document is good if the odds of its path and its own evidence together say so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, in_pandas, words

#: Labelled documents to learn from, on average; a bound, whatever the size of the input.
SAMPLE_LABELS = 12_000
#: A sign is in so many documents and in this share of the bad ones, its ratio is so large (natural log), and its shares are so
#: many standard deviations apart.
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT, LEAST_Z = 6, 0.01, 3.0, 6.0
#: Words of the model at most, the clearest first; it goes to the driver and to every task.
MOST_WORDS = 20_000
#: A site pulls no document further than this, in log odds from the global rate.
MOST_PULL = 2.0
#: Bytes of all sites up to which they are broadcast; more are joined by shuffles.
SITE_BYTES = 32 << 20
#: Strength of a prior, in documents, within these bounds.
WEAKEST, STRONGEST = 1.0, 1e6


@dataclass
class Signs:
    """Weight of each sign for poor and for toxic, and the log odds of either before evidence."""

    weights: dict[str, list[float]]
    prior: list[float]


_BARE = re.compile(r"[^\s.,;:?\"'()\[\]]+")
#: Of each byte: 0 small letter, 1 capital, 2 mark, 3 anything else.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[[*b"#*$%&|<>!"]] = 0, 1, 2


def features(text: str | None) -> set[str]:
    """Words as they stand, words in lower case without marks around them, and the words for the text's shape, which begin with a blank."""
    text = text or ""
    found = text.split()
    own, n = set(found), len(found)
    shape = {f" length {n.bit_length()}"}
    if n >= 20:
        small, capital, mark, rest = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=4)
        shape |= {f" repetition {10 * len(own) // n if n < 300 else 'long'}", f" runs {10 * sum(map(str.__eq__, found, found[1:])) // n}", f" capitals {5 * capital // max(1, small + capital)}", f" marks {20 * mark // max(1, small + capital + mark + rest)}"}
    return own | {*_BARE.findall(text.lower())} | shape


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> DataFrame:
    """text, poor and toxic (0/1) of a sample of the labelled documents, without copies.

    Null ids and labels take no part, of repeated ids the worst label counts.  Of texts with the same least hash of a 3-word
    shingle, as most near copies have, one stays: else whatever a copied text says would pass for a sign.
    """
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, sample / max(1, usable.count()))
    some = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    some = some.groupBy("doc_id").agg(*(F.max(c.cast("int")).alias(k) for k, c in (("poor", F.col("quality") <= 0), ("toxic", F.col("toxic") > 0))))
    w, n = words(F.col("text")), F.size(words(F.col("text")))
    least = F.when(n >= 3, F.array_min(F.transform(F.arrays_zip(w, F.slice(w, 2, n), F.slice(w, 3, n)), lambda x: F.xxhash64(x)))).otherwise(F.xxhash64(w))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # twice the sample at most
    return rows.withColumn("least", least).groupBy("least").agg(F.min_by(F.struct("text", "poor", "toxic"), "doc_id").alias("x")).select("x.*")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS) -> Signs:
    rows = labelled(docs, labels, sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for text, poor, toxic in zip(b["text"], b["poor"], b["toxic"], strict=True):
                for w in ("", *features(text)):
                    x = n.setdefault(w, [0, 0, 0])
                    x[0] += 1
                    x[1] += poor
                    x[2] += toxic
            yield pd.DataFrame({"word": [*n], **{k: [x[i] for x in n.values()] for i, k in enumerate(("n", "poor", "toxic"))}})

    counted = in_pandas(rows, count, "word string, n long, poor long, toxic long")
    counted = cut(counted.groupBy("word").agg(*(F.sum(k).alias(k) for k in ("n", "poor", "toxic"))).where(F.col("n") >= LEAST_DOCS))
    total = counted.where("word = ''").first()
    out = Signs({}, [-math.inf, -math.inf])
    for i, kind in enumerate(("poor", "toxic")):
        if total is None or not 0 < total[kind] < total["n"]:
            continue
        n_bad, n_rest = total[kind], total["n"] - total[kind]
        out.prior[i] = math.log(n_bad / n_rest)
        p, q = (F.col(kind) + 0.5) / (n_bad + 1.0), (F.col("n") - F.col(kind) + 0.5) / (n_rest + 1.0)
        both = (F.col("n") + 1.0) / (total["n"] + 2.0)
        z = (p - q) / F.sqrt(both * F.greatest(1 - both, F.lit(1e-9)) * (1.0 / n_bad + 1.0 / n_rest))
        signs = counted.where("word <> ''").select("word", F.ln(p / q).alias("weight"), z.alias("z"), p.alias("p")).where((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("p") >= LEAST_SHARE))
        for r in signs.orderBy(F.desc("z"), "word").limit(MOST_WORDS).collect():
            out.weights.setdefault(r["word"], [0.0, 0.0])[i] = r["weight"]
    return out


def evidence(docs: DataFrame, signs: Signs, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` (text among them or not) with _poor and _toxic, the log odds of a text before sites count."""
    weights, prior = signs.weights, signs.prior

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # columns go through as they are, text apart, which is the last
            found = [[weights[w] for w in features(t) & weights.keys()] for t in b.column(b.num_columns - 1).to_pylist()]
            odds = [pa.array([sum(x[i] for x in f) + prior[i] for f in found], type=pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *odds], [*b.schema.names[:-1], "_poor", "_toxic"])

    rows = docs.select(*columns, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", _poor double, _toxic double"
    return in_arrow(rows, of, schema)


def _bad(pull=0.0):
    """Posterior share of being poor or toxic."""
    good = lambda c: 1 / (1 + F.exp(F.least(F.greatest(F.col(c) + pull, F.lit(-30.0)), F.lit(30.0))))
    return 1 - good("_poor") * good("_toxic")


def _strength(sites: DataFrame, rate: str) -> DataFrame:
    """One row: the strength of the Beta prior by which the rates bad / n of ``sites`` scatter around ``rate``.

    Of their squared deviations, chance accounts for rate * (1 - rate) / n; what is left is the variance of the prior.
    """
    m = F.least(F.greatest(F.col(rate), F.lit(1e-6)), F.lit(1 - 1e-6))
    own = m * (1 - m)
    extra = F.sum(F.col("n") * (F.pow(F.col("bad") / F.col("n") - m, 2) - own / F.col("n"))) / F.sum("n")
    strength = F.avg(own) / F.greatest(extra, F.lit(1e-9)) - 1
    return sites.agg(F.coalesce(F.least(F.greatest(strength, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST)).alias("strength"))


def site_odds(scored: DataFrame) -> DataFrame:
    """_host, _path and pull: by how much the posterior rate of the path moves the log odds off the global rate.

    Marked for broadcast if all sites take SITE_BYTES or less, so that texts needn't be shuffled to meet them.
    """
    paths = cut(scored.groupBy("_host", "_path").agg(F.sum(_bad()).alias("bad"), F.count("*").alias("n")))
    hosts = paths.groupBy("_host").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    all_bad, all_n = hosts.agg(F.sum("bad"), F.sum("n")).first()
    rate = (all_bad or 0.0) / (all_n or 1)
    host_strength = _strength(hosts.withColumn("rate", F.lit(rate)), "rate").first()["strength"]
    hosts = hosts.select("_host", ((F.col("bad") + rate * host_strength) / (F.col("n") + host_strength)).alias("rate"))
    paths = paths.join(hosts, "_host")
    path_strength = _strength(paths, "rate").first()["strength"]
    post = (F.col("bad") + F.col("rate") * path_strength) / (F.col("n") + path_strength)
    logit = lambda p: F.ln(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    pull = F.least(F.greatest(logit(post) - logit(F.lit(rate)), F.lit(-MOST_PULL)), F.lit(MOST_PULL))
    out = paths.select("_host", "_path", pull.alias("pull"))
    size = paths.agg(F.sum(F.octet_length("_host") + F.octet_length("_path") + 64)).first()[0] or 0
    return F.broadcast(out) if size <= SITE_BYTES else out


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: list[str] | None = None, sample: int = SAMPLE_LABELS) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with _score, the share of being good, for every document.

    Null host or path: a site of its own, named by the empty string.  Null and empty texts have no evidence and go by their
    site.  A way to be bad of which the usable labels have
    no case, or nothing else, is left out; without any label every document is good.  No rows: no rows out.
    """
    keep = docs.columns if keep is None else keep
    signs = learn(docs, labels, sample)
    held = {c: f"_c{i}" for i, c in enumerate(keep)}  # whatever the columns are called
    site = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    sited = docs.select(*(F.col(c).alias(x) for c, x in held.items()), "text", site(host, "_host"), site(path, "_path"))
    scored = evidence(sited, signs, [*held.values(), "_host", "_path"])
    if "text" in keep:  # texts are rather scored twice than written
        pulls = site_odds(evidence(sited, signs, ["_host", "_path"]))
    else:
        scored = cut(scored)
        pulls = site_odds(scored)
    scored = scored.join(pulls, ["_host", "_path"])
    return scored.select(*(F.col(x).alias(c) for c, x in held.items()), (1 - _bad(F.col("pull"))).alias("_score"))


def apply_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """``docs`` whose share of being good reaches ``threshold``; same columns."""
    scored = classify(docs, labels, **how)
    return scored.toDF(*docs.columns, "\0score").where(F.col("`\0score`") >= threshold).select(*docs.columns)

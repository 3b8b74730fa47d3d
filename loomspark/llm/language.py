"""Language identification by prediction by partial matching.

For each language a byte context tree of depth ORDER holds how often each byte followed each context.  A byte costs
-log2 n(context, byte) / (n + d) bits where the context knows it, n being the context's count and d the number of its different
bytes; else the escape, -log2 d / (n + d), and the cost under the next shorter context; under none, eight bits.  Statistics
are frozen after learning, so the code length of a text is exact and does not depend on what came before it.  A text is
compressed as runs of letters, lower case, a blank between two; the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_pandas

ORDER = 3
#: Documents of a language to learn from, on average; a bound, whatever the size of the input.
SAMPLE_DOCS = 1500
SLICE_BYTES = 2 << 20
_OTHER = regex.compile(r"\P{L}+")
#: As many blanks before each text as the longest context has bytes.
_PAD = b" " * ORDER


def plain(text: str | None) -> bytes:
    """Runs of letters, lower case, each followed by a blank; empty if there is no letter."""
    runs = _OTHER.sub(" ", text or "").strip().lower()
    return runs.encode("utf-8", "replace") + b" " if runs else b""


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of all texts, padding apart: itself behind the ORDER bytes before it, in one number; and the text's number."""
    data = np.frombuffer(b"".join(_PAD + t for t in texts), dtype=np.uint8).astype(np.int64)
    size = np.array([len(t) + ORDER for t in texts])
    key = np.zeros(len(data), dtype=np.int64)
    for back in range(ORDER + 1):
        key[back:] |= data[: len(data) - back] << (8 * back)
    of = np.repeat(np.arange(len(texts)), size)
    scored = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) >= ORDER
    return key[scored], of[scored]


def sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i + 1, len(texts[i])
        while j < len(texts) and n + len(texts[j]) <= SLICE_BYTES:
            n, j = n + len(texts[j]), j + 1
        yield i, j
        i = j


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class ContextTree:
    """Counts of one language by depth: grams, their counts, contexts, their counts and their numbers of different bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for depth in range(ORDER + 1):
            gram, inverse = np.unique(keys & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            n = np.bincount(inverse, weights=counts, minlength=len(gram))
            context, inverse = np.unique(gram >> 8, return_inverse=True)
            self.levels.append((gram, n, context, np.bincount(inverse, weights=n, minlength=len(context)), np.bincount(inverse, minlength=len(context)).astype(float)))

    def cost(self, keys: np.ndarray, depth: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each gram."""
        if depth < 0:
            return np.full(len(keys), 8.0)
        keys = keys & ((1 << 8 * (depth + 1)) - 1)
        gram, n, context, total, different = self.levels[depth]
        at, known = _found(gram, keys)
        c, seen = _found(context, keys >> 8)
        all_of = np.where(seen, total[c] + different[c], 1.0) if len(context) else np.ones(len(keys))
        out = np.zeros(len(keys))
        if known.any():
            out[known] = -np.log2(n[at[known]] / all_of[known])
        escape = ~known
        if escape.any():
            first = np.where(seen[escape], -np.log2(np.where(seen[escape], different[c[escape]] if len(context) else 1.0, 1.0) / all_of[escape]), 0.0)
            out[escape] = first + self.cost(keys[escape], depth - 1)
        return out


class Model:
    """Trees of all languages, and a table of the costs of every gram that was learnt from."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        self.trees = [ContextTree(part["gram"].to_numpy(), part["n"].to_numpy(dtype=float)) for part in (counts[counts["lang"] == x] for x in self.languages)]
        self.known = np.unique(counts["gram"].to_numpy(dtype=np.int64))
        self.table = np.stack([t.cost(self.known) for t in self.trees], axis=1) if self.languages else np.zeros((0, 0))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, j in sliced(texts):
            key, of = grams(texts[i:j])
            at, known = _found(self.known, key)
            rare = np.flatnonzero(~known)
            for k, tree in enumerate(self.trees):
                cost = self.table[at, k]
                cost[rare] = tree.cost(key[rare])
                out[i:j, k] = np.bincount(of, weights=cost, minlength=j - i)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior share under equal priors."""
        bodies = [plain(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.bits(bodies)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.minimum(0.0, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
        some = np.array([len(b) > 0 for b in bodies], dtype=bool)
        return [self.languages[k] if s else "und" for k, s in zip(best, some, strict=True)], np.where(some, share, 0.0)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, folds: int = 5) -> Model:
    """From the texts of a bounded sample of documents with a language, held-out ones apart; rows are picked by a hash of their id."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)).select("doc_id", "lang", "text")
    share = {r["lang"]: min(1.0, sample_docs / r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(s * 1_000_000))) for x, s in share.items())) if share else F.lit(0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                texts = [plain(t) for t in part["text"]]
                for i, j in sliced(texts):
                    gram, n = np.unique(grams(texts[i:j])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit).select("lang", "text")
    counted = in_pandas(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(counted.toPandas())


def identify(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Null texts and texts without a letter: ``und`` with score 0, as for any text if nothing could be learnt.  Ties go to the
    language that sorts first.  Null doc_id: not held out, and never learnt from.  Repeated rows each get a row.  No rows: no
    rows out.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = model.predict([*b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": lang, "score": score})

    out = in_pandas(docs.select("doc_id", "text"), of, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")

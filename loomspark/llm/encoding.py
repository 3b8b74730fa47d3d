"""BPE encoding and decoding of documents by the automaton of ``bpe``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .bpe import tokenizer
from .common import in_pandas


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, the tokens of every whole text (array of int); null and empty texts have none."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [[*memoryview(t.encode(x or "")[0]).cast("I")] for x in b["text"]]})

    return in_pandas(docs.select("doc_id", "text"), of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, the labels of the arcs that ``ids`` name; null ids: empty text."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t.decode([] if x is None else x) for x in b["ids"]]})

    return in_pandas(encoded.select("doc_id", "ids"), of, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, encoded and decoded in one pass.

    Null and empty texts have no tokens.  Null and repeated doc_id: every row stands for itself.  No rows: no rows out.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            got = []
            for text in b["text"]:
                ids, labels = t.encode(text or "")
                got.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(labels.encode()).hexdigest()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [x for x, _, _ in got], "ids_sha256": [x for _, x, _ in got], "decoded_sha256": [x for _, _, x in got]})

    return in_pandas(docs.select("doc_id", "text"), of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

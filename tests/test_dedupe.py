"""Texts are held against accepted texts only, ids ascending."""

import random
import re
from pathlib import Path

import duckdb

from loomspark.functions.lineage import shared
from loomspark.operators import registry


def text(first, last):
    return " ".join(f"w{i}" for i in range(first, last))


def plain(rows):
    """The same in a loop."""
    hashes, sets, out = set(), [], {}
    for doc_id, t in sorted(rows):
        w = re.findall("[a-z0-9]+", t.lower()) if t is not None else None
        g = {*zip(*(w[i:] for i in range(5)))} if w else set()
        if w is not None and tuple(w) in hashes:
            out[doc_id] = "exact"
        elif any(g and s and len(g & s) / len(g | s) > 0.8 for s in sets):
            out[doc_id] = "near"
        else:
            out[doc_id] = "kept"
            sets.append(g)
            if w is not None:
                hashes.add(tuple(w))
    return out


def test_dedupe(spark, tmp_path):
    chain = [(10 + i, text(8 * i, 100 + 8 * i)) for i in range(7)]  # neighbours are near, others are not
    rows = [*chain, (5, "A b, c"), (6, "a B c"), (7, ""), (8, ""), (9, None), (3, None), (30, chain[1][1]), (31, chain[2][1].upper()), (32, chain[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.verdict for r in registry.QUERIES["M15_dedupe"](spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    assert [got[10 + i] for i in range(5)] == ["kept", "near", "kept", "near", "kept"]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(duckdb.sql(registry.ORACLES["M15_dedupe"].replace(";", "")).fetchall())


def test_dedupe_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["M15_dedupe"](spark, str(tmp_path)).collect() == []


def written_by(spark, tmp_path, name):
    """Rows of a query over unlike texts in eight files, and how much it left in the shared folder, as a share of the texts."""
    r = random.Random(1)
    rows = [(i, " ".join(f"{r.getrandbits(40):010x}" for _ in range(400))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    folder = Path(shared(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    n = registry.QUERIES[name](spark, str(tmp_path)).count()
    return n, (size() - before) / sum(len(t) for _, t in rows)


def test_texts_are_not_written(spark, tmp_path):
    n, share = written_by(spark, tmp_path, "M15_dedupe")
    assert n == 400 and share < 0.6


def test_texts_of_near_copies_are_not_written(spark, tmp_path):
    n, share = written_by(spark, tmp_path, "J06_near_copies")
    assert n == 0 and share < 0.6

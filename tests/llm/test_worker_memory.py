"""What a Python worker keeps after a stage of the pipeline, and what the rounds of components leave behind."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import regex
from loomspark.llm import components, packing, simhash, substring

HELD = """
import re, numpy, pandas, pyarrow, pyspark.sql
def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
before = held()
%s
print(held() - before)
"""


def grown(code):
    """MB that a fresh process holds more after some code."""
    return float(subprocess.run([sys.executable, "-c", HELD % code], capture_output=True, text=True, check=True, timeout=120, cwd=Path(packing.__file__).parents[2]).stdout.split()[-1])


def test_the_packing_module_holds_no_unrolled_pattern():
    assert grown("import loomspark.llm.packing") < 20  # 69 before


def test_small_slices_leave_small_tables():
    code = "from loomspark.llm import substring\nfor b in (substring.BYTE_BASE, substring.WORD_BASE):\n    substring._power_table(b, 5000)"
    assert grown(code) < 20  # 81 before, whatever the slices


def test_power_tables_grow_and_agree():
    base, substring_powers = substring.BYTE_BASE, substring._powers
    substring_powers.pop(base, None)
    small = [x.copy() for x in substring._power_table(base, 10)]
    large = substring._power_table(base, 1000)
    for a, b in zip(small, large, strict=True):
        assert len(a) >= 10 and len(b) >= 1000 and (a == b[: len(a)]).all()
    with np.errstate(over="ignore"):
        assert (large[0] * large[1] == 1).all()
    assert len(substring._power_table(base, substring.SLICE_BYTES + 1)[0]) == substring.SLICE_BYTES + 1


def test_long_runs_are_those_of_the_plain_pattern(monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 4)
    plain = regex.compile(f"[{packing.SPACE}]{{4,}}+")
    for text in ("", "    ", "a   b", "a    b", " a  \t\n b　　　　　c     ", "ab" * 5, " " * 3 + "x" + " " * 9):
        assert [m.span() for m in packing._long_runs(text)] == [m.span() for m in plain.finditer(text)]


def test_frequent_keys_are_counted_alike(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << 63, (40, simhash.WORDS), dtype=np.uint64)[r.integers(0, 40, 300) // 4]
    prints = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(words)], "name long, fp binary").repartition(3)
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    got = []
    for few in (simhash.FEW_PRINTS, 0):
        monkeypatch.setattr(simhash, "FEW_PRINTS", few)
        got.append(sorted(map(tuple, simhash._dealt(prints).collect())))
    assert got[0] == got[1] and len(got[0])


def test_rounds_of_components_have_few_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = components.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long"))
        assert got.rdd.getNumPartitions() <= 16
        assert {x.root for x in got.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)

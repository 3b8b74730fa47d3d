"""Quality rules as a short-circuit cascade.

A rule is a condition on which a document fails.  On a bounded sample each rule's rejection share is counted and its cost is
estimated from what its features go through; the rules then stand in one conditional expression in falling order of rejection per cost, so that a document pays only
for the rules up to the first that it fails.  The order never changes a verdict.

Only DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Rows, on average, of the sample on which the order is decided, whatever the size of the input.
SAMPLE_ROWS = 2000
#: Fixed shares, in hundredths.
MIN_WORDS, MAX_REPEAT, MAX_SYMBOLS, MAX_DUP_LINES, MIN_MEAN_CHARS, MAX_MEAN_CHARS = 50, 50, 20, 50, 200, 1500
MIN_LETTERS, MAX_BULLETS, MAX_ELLIPSES = 50, 90, 50


def split_words(docs: DataFrame) -> DataFrame:
    """``docs`` and _words, made once: the rules share it."""
    return docs.withColumn("_words", words(F.col("text")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: the optimizer copies a column's expression into each of its uses, but not this."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _word_chars(w: Column) -> Column:
    return F.char_length(F.array_join(w, "")).cast("long")


def _symbols(w: Column) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")


def _lines() -> Column:
    return F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _dup_lines(w: Column) -> Column:
    return (F.size(_lines()) - F.size(F.array_distinct(_lines()))).cast("long")


def _letters(w: Column) -> Column:
    return F.coalesce(F.char_length(F.regexp_replace("text", r"\P{L}+", "")), F.lit(0)).cast("long")


def _lines_like(pattern: str) -> Callable[[Column], Column]:
    return lambda w: F.size(F.filter(_lines(), lambda x: x.rlike(pattern))).cast("long")


#: Texts of up to so many words keep hash and place of a window in one 64-bit number; longer ones compare windows as strings.
PACKED_WORDS = 1 << 15


def _hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    Windows are sorted by hash and place; those with an equal neighbour repeat.  Each repeating window then adds the words
    up to the start of the next one, three at most.  Sorting plain numbers is far cheaper than sorting structs, so the place
    takes the low bits that the text's length needs and the hash the rest.  Neighbours with equal hashes are compared word by
    word; a text in which two such differ has its windows sorted as strings, so the number is exact.
    """
    n, at, zero = F.size(w), F.get, F.lit(0).cast("long")
    bits = F.length(F.bin(n))
    high = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: (x - F.call_function("shiftleft", high(x), bits)).cast("int")
    windows = lambda of: F.transform(F.sequence(F.lit(0), n - 3), of)
    beside = lambda s, key: F.filter(s, lambda x, i: (key(x) == key(at(s, i + 1))) | (key(x) == key(at(s, i - 1))))
    same = lambda p, q: (at(w, p) == at(w, q)) & (at(w, p + 1) == at(w, q + 1)) & (at(w, p + 2) == at(w, q + 2))
    clash = lambda s: F.size(F.filter(s, lambda x, i: (high(x) == high(at(s, i + 1))) & ~same(place(x), place(at(s, i + 1))))) > 0
    packed = bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.sort_array(windows(lambda i: F.call_function("shiftleft", _hash(at(h, i), at(h, i + 1), at(h, i + 2)), bits).bitwiseOR(i.cast("long")))))
    by_hash = bound(bound(packed, lambda s: beside(s, high)), lambda s: F.when(~clash(s), F.transform(s, place)))
    named = F.sort_array(windows(lambda i: F.struct(F.concat_ws(" ", at(w, i), at(w, i + 1), at(w, i + 2)).alias("s"), i.alias("p"))))
    by_words = bound(named, lambda s: F.transform(beside(s, lambda x: x["s"]), lambda x: x["p"]))
    covered = lambda ps: F.aggregate(F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(at(ps, i + 1) - p, F.lit(3))).cast("long")), zero, lambda a, x: a + x)
    return F.when(n < 3, zero).otherwise(bound(F.sort_array(F.coalesce(F.when(n <= PACKED_WORDS, by_hash), by_words)), covered))


#: Features that the rules need, each from the words of a text and the text itself.
FEATURES: Mapping[str, Callable[[Column], Column]] = {
    "n_words": lambda w: F.size(w).cast("long"),
    "word_chars": _word_chars,
    "n_symbols": _symbols,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda w: F.size(_lines()).cast("long"),
    "n_bars": lambda w: F.coalesce(F.regexp_count("text", F.lit(r"\|")), F.lit(0)).cast("long"),
    "n_letters": _letters,
    "n_bullet_lines": _lines_like(r"^[\x20\x09]*[*\u2022\u25aa\u25cf-]"),
    "n_ellipsis_lines": _lines_like(r"(\.\.\.|\u2026)[\x20\x09\x0D]*$"),
}
#: About how many nanoseconds of a core each takes on a text of so many characters and words, once the words are split; only the
#: order of rules depends on it.
WORK: Mapping[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda chars, n: F.lit(1.0),
    "word_chars": lambda chars, n: 5.0 * chars,
    "n_symbols": lambda chars, n: 25.0 * chars,
    "n_dup_lines": lambda chars, n: 30.0 * chars,
    "n_repeat_words": lambda chars, n: 350.0 * n * F.log2(n + F.lit(2)),
    "n_lines": lambda chars, n: 12.0 * chars,
    "n_bars": lambda chars, n: 10.0 * chars,
    "n_letters": lambda chars, n: 50.0 * chars,
    "n_bullet_lines": lambda chars, n: 15.0 * chars,
    "n_ellipsis_lines": lambda chars, n: 50.0 * chars,
}
#: Those that ``measure`` returns for every document; the others are computed only where a rule asks for them.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: Callable[[Mapping[str, Column]], Column]


BASE = (
    Rule("too_short", ("n_words",), lambda f: f["n_words"] < MIN_WORDS),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda f: f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT),
)
RULES = (
    *BASE,
    # Bars divide the cells of a table; a text isn't bad for having one.
    Rule("symbols", ("n_words", "n_symbols", "n_bars"), lambda f: (f["n_symbols"] * 100 > f["n_words"] * MAX_SYMBOLS) & ((f["n_symbols"] - f["n_bars"]) * 100 > f["n_words"] * MAX_SYMBOLS)),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: f["n_dup_lines"] * 100 > f["n_lines"] * MAX_DUP_LINES),
    Rule("short_or_long_words", ("n_words", "word_chars"), lambda f: (f["word_chars"] * 100 < f["n_words"] * MIN_MEAN_CHARS) | (f["word_chars"] * 100 > f["n_words"] * MAX_MEAN_CHARS)),
    Rule("few_letters", ("n_letters", "word_chars"), lambda f: f["n_letters"] * 100 < f["word_chars"] * MIN_LETTERS),
    Rule("bullets", ("n_bullet_lines", "n_lines"), lambda f: f["n_bullet_lines"] * 100 > f["n_lines"] * MAX_BULLETS),
    Rule("ellipses", ("n_ellipsis_lines", "n_lines"), lambda f: f["n_ellipsis_lines"] * 100 > f["n_lines"] * MAX_ELLIPSES),
)


def _features(w: Column, ready: Mapping[str, Column]) -> Mapping[str, Column]:
    return {k: ready[k] if k in ready else made(w) for k, made in FEATURES.items()}


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, ready: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """Rules with their rejection share and cost, most rejection per cost first; ties and an empty sample keep the given order.

    The cost of a rule is the mean over the sample of the WORK of the features it needs, in nanoseconds.  Features that are
    ``ready`` cost nothing.  All rules are looked at in one pass over the sample, and no clock is read, so that the same rows give
    the same order.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    seen = split_words(docs.select("text").sample(fraction=share, seed=7)).withColumn("_chars", F.coalesce(F.length("text"), F.lit(0)))
    needed = dict.fromkeys(k for rule in rules for k in rule.needs)
    seen = seen.select("*", *(FEATURES[k](F.col("_words")).alias(f"_f_{k}") for k in needed))
    f = {k: F.col(f"_f_{k}") for k in needed}
    chars, n = F.col("_chars"), F.size("_words")
    shares = [F.avg(F.coalesce(rule.fails(f), F.lit(False)).cast("int")).alias(f"share_{i}") for i, rule in enumerate(rules)]
    costs = [F.avg(sum((WORK[k](chars, n) for k in rule.needs if k not in ready), F.lit(1.0))).alias(f"cost_{i}") for i, rule in enumerate(rules)]
    got = seen.agg(*shares, *costs).first() if rules else None
    costed = [(rule, got[f"share_{i}"] or 0.0, got[f"cost_{i}"] or 1.0) for i, rule in enumerate(rules)]
    return sorted(costed, key=lambda x: -x[1] / x[2])


def verdict(rules: list[Rule], ready: Mapping[str, Column] | None = None, w: Column | None = None) -> Column:
    """Name of the first rule that fails, in the order given, or null; a later rule isn't evaluated.

    ``ready``: features that are there already; each rule computes what else it needs.  ``w``: the words, if they are there.
    """

    def chain(w: Column) -> Column:
        f, out = _features(w, ready or {}), F
        for rule in rules:
            out = out.when(rule.fails(f), F.lit(rule.name))
        return out if rules else F.lit(None).cast("string")

    return bound(words(F.col("text")), chain) if w is None else chain(w)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without the documents that fail a rule; same columns.

    Null and blank texts have no words and fail too_short.  A table without rows stays empty.  Other columns pass through.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules)]
    return docs.where(verdict(ordered).isNull())


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """MEASURED of every document, base_failed, and kept: no rule fails.

    The base is looked at first.  Only what passes it goes through the cascade of the other rules, which computes the features
    that are not MEASURED as it needs them.
    """
    ordered = [r for r, _, _ in order_rules(docs, tuple(r for r in rules if r not in BASE), ready=MEASURED)]
    rows = split_words(docs.select("doc_id", "text"))
    rows = rows.select("doc_id", "text", "_words", *(FEATURES[k](F.col("_words")).alias(k) for k in MEASURED))
    f = {k: F.col(k) for k in MEASURED}
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.fails(f)
    rows = rows.withColumn("base_failed", base)
    return rows.select("doc_id", *MEASURED, "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict(ordered, f, F.col("_words")).isNull()).alias("kept"))

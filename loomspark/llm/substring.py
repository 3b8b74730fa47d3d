"""Removal of repeated word passages by seed and extend.

Anchors.  Of the words of a text every window of ``width`` words has a least hash among its word 8-grams (leftmost on a tie);
that 8-gram is the window's anchor.  Equal windows have equal anchors at equal places, so comparing texts at anchors loses
nothing, and there are about two anchors for every 29 words.  Consecutive windows with one anchor form a run: the anchor,
extended to the left and to the right as far as it stays the anchor.

Join.  Anchors that occur once in the corpus can't be in a repeat and go.  Of the rest, runs with equal words repeat as a
whole.  A run that occurs once, but shares its anchor, is extended from the anchor step by step, so many words to the left and
the rest of ``width`` to the right; it matches another run of the anchor in the extensions whose words are equal.  Windows so
found, put together along a text, are its maximal repeats of ``width`` words or more.

Exactness.  Anchors may collide: they only say what is compared.  Words are compared by BLAKE2 digests of 64 bits of the words
themselves, and only under one anchor, which is 64 bits more.  A text is named by 128 bits of its SHA-256, so passes over the
input agree with each other however it is split, and copies of a text are one name.

The texts are shuffled once: extension, and the last join that takes the words out, read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.workers import ship

from .common import cut, in_arrow

WIDTH = 35
GRAM = 8
#: Bytes of text that are worked on at a time; a longer text is worked on by blocks of so many windows.
SLICE_BYTES, BLOCK_WINDOWS = 2 << 20, 1 << 18
#: Odd multipliers of the two polynomial hashes, and of the mixing step.
BYTE_BASE, WORD_BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: A text with over this share of all rows (so 256 texts at most) has its copies spread over so many keys in the join of texts.
HOT_SHARE, SALTS = 1 / 256, 64
#: Bits of a span that hold its number of windows; the first window is above.
SPAN_BITS = 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, ``n`` or more of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        m = max(n, min(1 << n.bit_length(), SLICE_BYTES + 1))  # as workers stay, small slices shouldn't leave large tables behind
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(m, dtype=np.uint64)
            out[1:] = np.uint64(b)
            made.append(np.multiply.accumulate(out))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the UTF-8 of some texts; offsets: where each text begins, and the end of the last."""
    n = len(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.ones(n + 1, dtype=bool), np.ones(n + 1, dtype=bool)
    before[1:] = np.append(blank, True)[:n]
    before[offsets] = True
    after[: max(0, n - 1)] = blank[1:]
    after[offsets[1:] - 1] = True  # an empty first text marks the place past the end, which isn't read
    return np.flatnonzero(~blank & before[:n]), np.flatnonzero(~blank & after[:n]) + 1


class Words:
    """The words of a few texts: hashes of their grams, digests of any stretch of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, (self.start, self.end) = data, word_bounds(data, offsets)
        #: First word of each text, and the number of all words.
        self.first = np.searchsorted(self.start, offsets)
        size = self.end - self.start
        #: Where words begin in ``body``, in which one blank follows each.
        self.at = np.concatenate(([0], np.cumsum(size + 1)))
        body = np.full(int(self.at[-1]), 32, dtype=np.uint8)
        if len(size):
            shift = np.repeat(self.at[:-1] - self.start, size)
            place = np.arange(len(shift)) + np.repeat(self.start - (np.cumsum(size) - size), size)
            body[place + shift] = data[place]
        self.body = body.tobytes()

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each place on; equal words, equal hash."""
        up, down = _power_table(BYTE_BASE, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        word = _mixed((total[self.end] - total[self.start]) * down[self.start])
        up, down = _power_table(WORD_BASE, len(word) + 1)
        total = np.zeros(len(word) + 1, dtype=np.uint64)
        np.cumsum(word * up[: len(word)], out=total[1:])
        return _mixed((total[n:] - total[:-n]) * down[: len(word) - n + 1])

    def digests(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the ``n`` words from each place of ``a``, by their bytes."""
        body, of = self.body, hashlib.blake2b
        return np.frombuffer(b"".join([of(body[i:j], digest_size=8).digest() for i, j in zip(self.at[a].tolist(), self.at[a + n].tolist(), strict=True)]), dtype=np.int64)


def runs(w: Words, width: int) -> tuple[np.ndarray, ...]:
    """Text, first window (place in the text), number of windows, anchor and digest of each run."""
    gram = min(GRAM, width)
    m = len(w.start)
    none = np.zeros(0, dtype=np.int64)
    if m < width:
        return none, none, none, none, none
    grams = w.grams(gram)
    least, place, size, want = grams, np.arange(len(grams)), 1, width - gram + 1
    while size < want:  # least of 1, 2, 4, ... grams, and at last of exactly as many as a window has
        step = min(size, want - size)
        left = least[:-step] <= least[step:]
        least, place, size = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:]), size + step
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    window = np.arange(len(least))
    inside = window + width <= w.first[text[: len(least)] + 1]
    window, place, of = window[inside], place[inside], text[: len(least)][inside]
    if not len(window):
        return none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (of[1:] != of[:-1]))))
    n = np.diff(np.append(new, len(window)))
    a, of = window[new], of[new]
    return of, a - w.first[of], n, grams[place[new]].view(np.int64), w.digests(a, n + width - 1)


def slices(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, int, Words]]:
    """Rows i to j of a batch, the place in its text of the first word, and the words; null: no words.

    A text longer than SLICE_BYTES comes alone, in blocks that overlap by the words that a window needs.
    """
    column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return
    where = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(where, where[i] + SLICE_BYTES, side="right")) - 1)
        part = data[where[i] : where[j]]
        if len(part) <= SLICE_BYTES:
            yield i, j, 0, Words(part, where[i : j + 1] - where[i])
        else:
            start, end = word_bounds(part, np.array([0, len(part)]))
            for a in range(0, max(1, len(start) - width + 1), BLOCK_WINDOWS):
                b = min(len(start), a + BLOCK_WINDOWS + width - 1) - 1
                block = part[start[a] : end[b]] if len(start) else part[:0]
                yield i, j, a, Words(block, np.array([0, len(block)]))
        i = j


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` and the name of the text, t1 and t2."""
    name = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    longs = (F.coalesce(F.conv(F.substring(name, at, 16), 16, -10).cast("long"), F.lit(0).cast("long")) for at in (1, 17))
    return docs.select("*", *(x.alias(t) for x, t in zip(longs, ("t1", "t2"), strict=True)))


def _spread(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``named`` with a salt, zero but for copies of hot texts; and these texts' names, HOT_SHARE bounds how many."""
    counts = cut(named.groupBy("t1", "t2").agg(F.count("*").alias("c")).where("c > 1"))
    hot = counts.where(F.col("c") > F.lit(named.count() * HOT_SHARE)).select("t1", "t2", F.lit(True).alias("hot"))
    hot = cut(hot)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int")
    return named.join(F.broadcast(hot), ["t1", "t2"], "left").withColumn("salt", salt).drop("hot"), hot


def _salted(by_name: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of hot names for every salt, others for zero."""
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return by_name.join(F.broadcast(hot), ["t1", "t2"], "left").withColumn("salt", F.explode(salts)).drop("hot")


def _names(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("t1", "t2")]


def _anchors(named: DataFrame, width: int) -> DataFrame:
    """anchor, run, t1, t2 and span of every run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = _names(b)
            for i, j, base, w in slices(b, width):
                text, a, n, anchor, run = runs(w, width)
                span = (a + base) << SPAN_BITS | n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, run, names[0][i:j][text], names[1][i:j][text], span)], ["anchor", "run", "t1", "t2", "span"])

    return in_arrow(named.select("text", "t1", "t2"), of, "anchor long, run long, t1 long, t2 long, span long")


def _extensions(texts: DataFrame, width: int) -> DataFrame:
    """Of texts with ``asked``, an array of runs (anchor, span, once): the extensions of each from its anchor to ``width`` words.

    Those of runs that occur once have their place (t1, t2, span); the others repeat anyway and are there to be met.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            names = _names(b)
            if not len(names[0]):
                continue
            before = [np.concatenate(([0 if last is None else last[k]], names[k][:-1])) for k in range(2)]
            new = (names[0] != before[0]) | (names[1] != before[1])  # copies come one after another
            new[0] |= last is None
            last = [names[k][-1] for k in range(2)]
            b = b.filter(pa.array(new))
            names, asked = _names(b), b.column(b.schema.get_field_index("asked"))
            for i, j, base, w in slices(b, width):
                part = asked.slice(i, j - i)
                flat = part.flatten()
                text = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                anchor, span, once = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                a, n = (span >> SPAN_BITS) - base, span & ((1 << SPAN_BITS) - 1)
                k = np.repeat(np.arange(len(a)), n)
                s = a[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                here = (s >= 0) & (s + width <= np.diff(w.first)[text[k]])  # of a long text: in this block
                k, s = k[here], s[here]
                digest = w.digests(w.first[text[k]] + s, np.full(len(s), width))
                known = once[k] == 0
                place = (pa.array(x, mask=known) for x in (names[0][i:j][text[k]], names[1][i:j][text[k]], (s + base) << SPAN_BITS | 1))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), pa.array(digest), *place], ["anchor", "words", "t1", "t2", "span"])

    return in_arrow(texts, of, "anchor long, words long, t1 long, t2 long, span long")


def _with_spans(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (a column text) and ``spans``: which windows begin anywhere else too, as first window and number in one long."""
    named = _named(docs)
    spread, hot = _spread(named)
    raw = _anchors(named, width)
    again = cut(raw.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    found = cut(raw.join(again, "anchor", "left_semi"))
    classes = found.groupBy("anchor", "run").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "span")).alias("r"))
    classes = cut(classes.select("anchor", "run", "c", "r.*"))
    whole = found.join(classes.where("c > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select("t1", "t2", "span")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("c").alias("least")).where("k > 1 AND least = 1").select("anchor")
    asked = classes.join(mixed, "anchor", "left_semi").groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "span", (F.col("c") == 1).cast("int").alias("once"))).alias("asked"))
    # One run never has equal extensions, and the text of a run that occurs once has no copy: two rows are two runs, or none of them occurs once.
    extended = _extensions(spread.join(_salted(asked, hot), ["t1", "t2", "salt"]), width)
    shared = extended.groupBy("anchor", "words").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "words")
    parts = extended.where("span IS NOT NULL").join(shared, ["anchor", "words"], "left_semi").select("t1", "t2", "span")
    spans = whole.unionByName(parts).groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))
    return spread.join(_salted(spans, hot), ["t1", "t2", "salt"], "left").drop("t1", "t2", "salt")


def kept_words(body: bytes, spans: np.ndarray | None, width: int) -> tuple[bytes, int, int]:
    """The words that no span covers, with single blanks between; the number of all words, and of those that are covered."""
    if len(body) <= SLICE_BYTES and spans is None:
        w = body.split()
        return b" ".join(w), len(w), 0
    data = np.frombuffer(body, dtype=np.uint8)
    start, end = word_bounds(data, np.array([0, len(data)]))
    step = np.zeros(len(start) + 1, dtype=np.int64)
    if spans is not None:
        a = spans >> SPAN_BITS
        np.add.at(step, a, 1)
        np.add.at(step, a + (spans & ((1 << SPAN_BITS) - 1)) + width - 1, -1)
    keep = np.cumsum(step[:-1]) == 0
    cuts = np.flatnonzero(np.diff(np.concatenate(([0], keep.astype(np.int8), [0]))))
    stretches = [b" ".join(body[start[i] : end[j - 1]].split()) for i, j in zip(cuts[::2], cuts[1::2], strict=True)]
    return b" ".join(stretches), len(start), int((~keep).sum())


def _span_lists(column: pa.Array) -> list[np.ndarray | None]:
    return [None if x is None or not len(x) else np.array(x, dtype=np.int64) for x in column.to_pylist()]


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words kept, joined by one space) of every document.

    Null, empty and blank texts have no words.  Copies of a text of ``width`` words or more lose all words.  Null and repeated
    doc_id: every row stands for itself.  No rows: no rows out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = (b.column(b.schema.get_field_index(c)) for c in ("text", "spans"))
            got = [kept_words(t or b"", s, width) for t, s in zip(texts.cast(pa.large_binary()).to_pylist(), _span_lists(spans), strict=True)]
            columns = [pa.array(x, pa.int64()) for x in ([n for _, n, _ in got], [g for _, _, g in got])]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *columns, pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in got])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width)
    return in_arrow(rows, of, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the covered words taken out of the texts that have any; other texts and columns stay as they are.

    What is left of a changed text has single blanks between its words.  A column n_chars, where there is one, follows it.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else kept_words(t.encode("utf-8", "surrogatepass"), np.asarray(s, dtype=np.int64), width)[0].decode("utf-8", "surrogatepass") for t, s in zip(text, spans, strict=True)], dtype=object)

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    spanned = _with_spans(docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), "text"), width)  # whatever the columns are called
    has = F.col("spans").isNotNull()
    rows = spanned.select("_row", "text", has.alias("has"), cleaned(F.when(has, F.col("text")), "spans").alias("cleaned"))
    new: dict[str, Column] = {"text": F.when(F.col("has"), F.col("cleaned")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("has"), F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return rows.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))

"""Token counts by finite-state transduction.

Words.  The tokenizer's automaton (``bpe``) is made into a deterministic transducer that reads letters.  What the tokens of a
word's prefix mean for all that may follow is the node of the suffix automaton it has reached, and for each prefix as far back
as that node's letters go the token that ends it and the number of tokens relative to now.  Prefixes that agree in this are one
state.  A transition leads to a state and emits the difference in tokens, which may be negative; the last letter, read with the
mark of a word's end, emits what completes the word.  States are made as texts reach them, MOST_STATES of them; a word that
would need more is counted by the automaton itself.

Texts.  A text is cut into chunks of equal length, wherever that falls.  Between two blanks the transducer is in its first
state, so what a chunk does to any state is said by three things: the text before its first blank, which completes whatever came
in; the tokens emitted between its first and last blank; and the text after its last blank, which leads from the first state to
the state it leaves.  (These are texts, not numbers of states: normalisation and splitting look across them.)  A chunk without a
blank only lengthens the word.  Such maps compose associatively.  Chunks of a long text go to different tasks; its maps are
composed by a balanced scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACE, Automaton, Tokenizer, tokenizer
from .common import cut, in_pandas, row_id

#: Characters a chunk; texts of over so many have their chunks dealt to tasks.
CHUNK, LONG_TEXT = 1 << 14, 1 << 22
#: States of the transducer that a worker keeps.
MOST_STATES = 60_000
_BLANK = regex.compile(f"[{SPACE}]")
_LAST = regex.compile(f"(?r)[{SPACE}]")


class Transducer:
    """Reads letters, emits numbers of tokens."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.depth = [0] * len(automaton.step)
        for node, steps in enumerate(automaton.step):  # a node comes after the one that leads to it
            for to in steps.values():
                self.depth[to] = self.depth[node] + 1
        #: Of each state its node, and for the prefixes from the present one back their last token (-1: no prefix) and count.
        first = (0, ((-1, 0),))
        self.numbers = {first: 0}
        self.states = [first]
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.last: list[dict[str, int]] = [{}]

    def _read(self, state: int, letters: tuple[str, ...]) -> tuple[int, int, int]:
        """Node after the letters (one place of the word), the token that ends there, and the tokens more than before."""
        a = self.automaton
        node, past = self.states[state]
        for x in letters:
            while x not in a.step[node] and node:
                node = a.back[node]
            node = a.step[node].get(x, 0)
        t = a.longest[node]
        while t >= 0:
            before, count = past[a.size[t] - 1]
            if before < 0 or a.arc(before, t):
                return node, t, count + 1
            t = a.shorter[t]
        raise ValueError(f"no path for {letters!r}")

    def step(self, state: int, letter: str) -> tuple[int, int] | None:
        """State and tokens emitted; None where that state would be one too many."""
        got = self.next[state].get(letter)
        if got is None:
            node, t, more = self._read(state, (letter,))
            key = (node, ((t, 0), *((u, n - more) for u, n in self.states[state][1][: self.depth[node]])))
            number = self.numbers.get(key)
            if number is None:
                if len(self.states) >= MOST_STATES:
                    return None
                number = self.numbers[key] = len(self.states)
                self.states.append(key)
                self.next.append({})
                self.last.append({})
            got = self.next[state][letter] = (number, more)
        return got

    def count(self, word: str) -> int:
        """Tokens of a word, in letters for bytes."""
        state, total = 0, 0
        for letter in word[:-1]:
            got = self.next[state].get(letter) or self.step(state, letter)
            if got is None:
                return len(self.automaton.encode(word))
            state, more = got
            total += more
        more = self.last[state].get(word[-1])
        if more is None:
            more = self.last[state][word[-1]] = self._read(state, (word[-1], self.automaton.end))[2]
        return total + more


@dataclass(frozen=True)
class StateMap:
    """head, emitted, tail as above; emitted is None where the chunk has no blank, and head is then all of it."""

    head: str
    emitted: int | None
    tail: str = ""


def chunk_map(t: Tokenizer, chunk: str) -> StateMap:
    first = _BLANK.search(chunk)
    if first is None:
        return StateMap(chunk, None)
    last = _LAST.search(chunk).start()
    return StateMap(chunk[: first.start()], t.count(chunk[first.start() : last]), chunk[last + 1 :])


def compose(t: Tokenizer, a: StateMap, b: StateMap) -> StateMap:
    if a.emitted is None:
        return StateMap(a.head + b.head, b.emitted, b.tail)
    if b.emitted is None:
        return StateMap(a.head, a.emitted, a.tail + b.head)
    return StateMap(a.head, a.emitted + t.count(a.tail + b.head) + b.emitted, b.tail)


def scan(t: Tokenizer, maps: list[StateMap]) -> StateMap:
    """Composition of neighbours, level by level."""
    while len(maps) > 1:
        maps = [compose(t, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0] if maps else StateMap("", None)


def finish(t: Tokenizer, whole: StateMap) -> int:
    """Tokens of a text, from the map of all of it."""
    return t.count(whole.head) + (0 if whole.emitted is None else whole.emitted + t.count(whole.tail))


def count(t: Tokenizer, text: str, chunk: int = CHUNK) -> int:
    return finish(t, scan(t, [chunk_map(t, text[i : i + chunk]) for i in range(0, len(text), chunk)]))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, long_text: int = LONG_TEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Null and empty texts have neither bytes nor tokens.  Null and repeated doc_id: every row stands for itself.  No rows: no
    rows out.  Texts of over ``long_text`` characters are counted by several tasks, with the same result.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            short = b["text"].map(lambda x: x is None or len(x) <= long_text).to_numpy(dtype=bool)
            done = b[short]
            yield done.assign(n_tokens=[count(t, x or "") for x in done["text"]], part=-1, chunk=None)[columns]
            for row in b[~short].itertuples():
                step = max(CHUNK, long_text // 4)
                cuts = [row.text[i : i + step] for i in range(0, len(row.text), step)]
                yield pd.DataFrame({"row": row.row, "doc_id": pd.array([row.doc_id], dtype=b["doc_id"].dtype)[[0] * len(cuts)], "n_bytes": row.n_bytes, "n_tokens": 0, "part": range(len(cuts)), "chunk": cuts})[columns]

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            maps = [scan(t, [chunk_map(t, x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]) for x in b["chunk"]]
            yield b[["row", "doc_id", "n_bytes", "part"]].assign(head=[m.head for m in maps], emitted=pd.array([m.emitted for m in maps], dtype="Int64"), tail=[m.tail for m in maps])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        t, rows = tokenizer(path), rows.sort_values("part")
        whole = scan(t, [StateMap(h, None if pd.isna(e) else int(e), x) for h, e, x in zip(rows["head"], rows["emitted"], rows["tail"], strict=True)])
        return rows[["doc_id", "n_bytes"]].head(1).assign(n_tokens=finish(t, whole))

    columns = ["row", "doc_id", "n_bytes", "n_tokens", "part", "chunk"]
    rows = docs.select(row_id().alias("row"), "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    first = cut(in_pandas(rows, of, "row long, doc_id long, n_bytes long, n_tokens long, part int, chunk string"))
    maps = in_pandas(first.where("part >= 0").repartition("row", "part"), mapped, "row long, doc_id long, n_bytes long, part int, head string, emitted long, tail string")
    long = maps.groupBy("row").applyInPandas(composed, "doc_id long, n_bytes long, n_tokens long")
    return first.where("part < 0").select("doc_id", "n_bytes", "n_tokens").unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)

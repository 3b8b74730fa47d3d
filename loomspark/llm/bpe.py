"""BPE as a deterministic automaton, for encoding, decoding and counting.

The automaton reads tokens.  It starts with a single state that loops on every base symbol, and merges are built in one after
another.  The gadget of merge (x, y) -> c: where an arc x leads to a state with an arc y, an arc c is added that goes where y
went, and arc x is led to a copy of its target without y.  All arcs of one token lead to one state, so a state is its token.

What a gadget takes away, compiled.  The state of c inherits the arcs of y, and an arc c leaves a state if x left it then.  So
merge (x, y) takes arc y, and all arcs that come after it with y as their first part, from the state of x and from all states
that come after it with x as their second part.  Tokens form a tree by their second parts and one by their first parts.
Numbered in postorder, children by age, what comes after x, and after y, are two ranges of numbers: each gadget clears a
rectangle of the table of states and arcs.  (With x = y the arc c goes too: of three x the first two merge.)  The rectangles are
cut into rows and joined into disjoint stretches, two arrays of integers in which one search says whether an arc is left.  The
result accepts exactly the token sequences that BPE makes.

Words.  A second table, a suffix automaton of the tokens' letters (Aho-Corasick), gives for every place of a word the longest
token that ends there, and for every token the next shorter one.  One token ends each prefix of a word: the only one with an
arc from the state where it begins.  Encoding fills that table from left to right by steps in the two automata; each arc emits
one token; the labels of the arcs passed are the tokens, and their texts are what decoding emits.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

#: Characters that the tokenizer's \s matches, its splitting pattern, and its sigma, which has no final form.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
SIGMA = ("Σ", "σ")
#: Words kept in memory in each of two generations.
CACHE_WORDS = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Automaton:
    """Of a vocabulary file with ``</w>`` after the last symbol of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._compile_arcs([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]])
        self._compile_letters()

    def _compile_arcs(self, merges: list[tuple[int, int, int]]) -> None:
        """Numbers ``row`` and ``column`` of each token, and the stretches ``gone`` to ``until`` of cleared cells."""
        n = len(self.labels)
        born = array("i", [-1] * n)
        for time, (_, _, c) in enumerate(merges):
            born[c] = time
        order = []
        for part in (1, 0):
            later: dict[int, list[int]] = {}
            for m in merges:
                later.setdefault(m[part], []).append(m[2])
            low, at, k = array("i", [0] * n), array("i", [0] * n), 0
            for base in (t for t in range(n) if born[t] < 0):
                low[base], stack = k, [(base, iter(later.get(base, ())))]
                while stack:
                    t, rest = stack[-1]
                    child = next(rest, None)
                    if child is None:
                        at[t], k = k, k + 1
                        stack.pop()
                    else:
                        low[child] = k
                        stack.append((child, iter(later.get(child, ()))))
            order.append((later, low, at))

        def first(part: int, t: int, time: int) -> int:
            """Number of the first of what comes after ``t`` at ``time`` or later."""
            later, low, at = order[part]
            of = later.get(t, ())
            k = bisect_left(of, time, key=born.__getitem__)
            return low[of[k]] if k < len(of) else at[t]

        self.row, self.column = order[0][2], order[1][2]
        cleared = np.array([(first(0, x, time + 1), self.row[x], first(1, y, time + (x != y)), self.column[y]) for time, (x, y, _) in enumerate(merges)], dtype=np.int64).reshape(-1, 4)
        rows = cleared[:, 1] - cleared[:, 0] + 1
        which = np.repeat(np.arange(len(cleared)), rows)
        base = (cleared[which, 0] + np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)) * n
        gone, until = base + cleared[which, 2], base + cleared[which, 3]
        by = np.argsort(gone, kind="stable")
        gone, until = gone[by], np.maximum.accumulate(until[by])
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(gone)), dtype=bool), gone[1:] > until[:-1])))
        self.gone, self.until = array("q", gone[new].tobytes()), array("q", until[np.append(new[1:], len(gone)) - 1].tobytes() if len(new) else b"")
        self.row = array("q", (np.array(self.row, dtype=np.int64) * n).tobytes())

    def _compile_letters(self) -> None:
        """Steps between nodes by letter; the longest token that ends at a node, the next shorter one, and sizes in letters."""
        self.step: list[dict[str, int]] = [{}]
        named = array("i", [-1])
        for t, i in self.ids.items():
            if t in self.special:
                continue
            node = 0
            for letter in self.spelt(t):
                at = self.step[node].get(letter)
                if at is None:
                    at = self.step[node][letter] = len(self.step)
                    self.step.append({})
                    named.append(-1)
                node = at
            named[node] = i
        self.back = array("i", [0] * len(self.step))
        self.longest = array("i", named)
        self.shorter, self.size = array("i", [-1] * len(self.labels)), array("i", [0] * len(self.labels))
        level, depth = [0], 0
        while level:
            depth, below = depth + 1, []
            for node in level:
                for letter, at in self.step[node].items():
                    below.append(at)
                    other = self.back[node]
                    while node and letter not in self.step[other] and other:
                        other = self.back[other]
                    self.back[at] = self.step[other].get(letter, 0) if node else 0
                    less = self.longest[self.back[at]]
                    if named[at] >= 0:
                        self.shorter[named[at]], self.size[named[at]] = less, depth - (letter == self.end)
                    else:
                        self.longest[at] = less
            level = below

    def spelt(self, t: str) -> list[str]:
        """Letters of a token; the mark of a word's end is one more."""
        return [*t[: -len(self.end)], self.end] if self.end and t.endswith(self.end) else [*t]

    def arc(self, u: int, v: int) -> bool:
        """Whether the state of token u has an arc v once all merges are built in."""
        cell = self.row[u] + self.column[v]
        k = bisect_right(self.gone, cell)
        return not k or self.until[k - 1] < cell

    def encode(self, word: str) -> list[int]:
        """Tokens of one word, in letters for bytes.  A letter that the vocabulary lacks: ValueError; byte vocabularies lack none."""
        step, back, longest, shorter, size, row, column, gone, until = self.step, self.back, self.longest, self.shorter, self.size, self.row, self.column, self.gone, self.until
        n, node = len(word), 0
        ending: list[int] = [-1] * (n + 1)
        for i, letter in enumerate((*word, self.end), 1):
            if i == n:
                last = letter
                continue  # the last letter is read with the mark that follows it
            for x in ((last, letter) if i > n else (letter,)):
                while x not in step[node] and node:
                    node = back[node]
                node = step[node].get(x, 0)
            at = min(i, n)
            t = longest[node]
            while t >= 0:
                j = at - size[t]
                if not j:
                    break
                cell = row[ending[j]] + column[t]
                k = bisect_right(gone, cell)
                if not k or until[k - 1] < cell:
                    break
                t = shorter[t]
            else:
                raise ValueError(f"no path for {word!r}")
            ending[at] = t
        out, at = [], n
        while at:
            out.append(ending[at])
            at -= size[ending[at]]
        return out[::-1]


class Cached(dict):
    """Of a function of a word: two generations of what it gave, so memory is bounded and frequent words stay."""

    def __init__(self, f):
        super().__init__()
        self.f, self.old = f, {}

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        got = self[word] = self.f(word) if got is None else got
        return got


@lru_cache(maxsize=1)
def marks() -> tuple[str, ...]:
    """One mark of each combining class, the first by code point."""
    found: dict[int, str] = {}
    for c in map(chr, range(0x300, 0x1F000)):
        found.setdefault(unicodedata.combining(c), c)
    return tuple(found[k] for k in sorted(found) if k)


class Odd(dict):
    """Whether a character is new to some table: unassigned here, or sorted or lowered otherwise than the library does.

    Its combining class, too: beside a mark of any class, on either side, the library must put both in the same order.
    """

    def __init__(self):
        super().__init__()
        self.lower, self.nfc = normalizers.Lowercase(), normalizers.NFC()
        self.kinds = [(pre_tokenizers.Split(Regex(x), "removed"), regex.compile(x)) for x in (r"\p{L}", r"\p{N}", r"\s")]

    def __missing__(self, c: str) -> bool:
        low = c if c in SIGMA else c.lower()
        got = unicodedata.category(c) in ("Cn", "Cs") or self.lower.normalize_str(c) != (SIGMA[1] if c in SIGMA else low)
        space = regex.compile(f"[{SPACE}]")
        for (split, own), mine in zip(self.kinds, (None, None, space), strict=True):
            got = got or (not split.pre_tokenize_str(c)) != bool((mine or own).match(c))
        got = got or any(self.nfc.normalize_str(x) != unicodedata.normalize("NFC", x) for m in marks() for x in (c + m, m + c))
        self[c] = got
        return got


class Tokenizer:
    """The file's tokenizer: special strings, normalisation, splitting into words, then the automaton."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.automaton.special, key=len, reverse=True))) + ")")
        self.split = regex.compile(SPLIT)
        #: The library's own tables, for parts of a text with a character on which tables of other versions differ.
        self.odd = Odd()
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.own_split = pre_tokenizers.Split(Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
        self.words = Cached(self._word)
        self.transducer = None
        self.counts = Cached(self._count)

    def _spelt(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.automaton.encode(self._spelt(word))
        return array("I", ids).tobytes(), self.decode(ids)

    def _count(self, word: str) -> int:
        if self.transducer is None:
            from .token_counts import Transducer

            self.transducer = Transducer(self.automaton)
        return self.transducer.count(self._spelt(word))

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, a blank between two: the file names no decoder that would join them.  An unknown id: KeyError."""
        return " ".join(map(self.automaton.labels.__getitem__, ids))

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words between special strings, and the ids of these."""
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                yield self.automaton.special[part]
            elif part and not part.isascii() and any(map(self.odd.__getitem__, set(part))):
                yield [x for x, _ in self.own_split.pre_tokenize_str(self.normal.normalize_str(part))]
            elif part:
                yield self.split.findall(unicodedata.normalize("NFC", part).replace(*SIGMA).lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit numbers, and the decoded text."""
        ids, labels = [], []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                ids.append(array("I", [piece]).tobytes())
                labels.append(self.automaton.labels[piece])
            elif piece:
                got = [*map(self.words.__getitem__, piece)]
                ids += [x for x, _ in got]
                labels += [x for _, x in got]
        return b"".join(ids), " ".join(labels)

    def count(self, text: str) -> int:
        return sum(1 if isinstance(p, int) else sum(map(self.counts.__getitem__, p)) for p in self.pieces(text))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """Once for each Python worker."""
    return Tokenizer(path)

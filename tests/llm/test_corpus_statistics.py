"""Phrases, language-model scores and importance resampling against plain versions, on the edge cases of ``fixtures``."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from loomspark.llm import importance, lm_scoring, phrases

from .fixtures import ROWS, docs, empty, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# phrases


def plain_phrases(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


PHRASES = [(1, "new york city. New York City, new york City! york\tnew\x0bcity of york", "en", None)] * 6 + [(2, "the the the the the the the the the the the the", None, None), (3, "À la carte " * 7, "und", None), (4, "a b c d e " * 12, "en", None), (5, "a b c d f " * 11, "de", None)]


@pytest.mark.parametrize("longest, most", [(3, 1 << 20), (4, 1 << 20), (4, 0)])
def test_phrases(spark, monkeypatch, longest, most):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    rows = [*ROWS, *PHRASES]
    got = phrases.mine(docs(spark, rows), longest=longest, top=4, most=most)
    assert sorted(map(tuple, got.collect())) == plain_phrases([(r[2], r[1]) for r in rows], longest, 10, 4)


def test_no_phrases(spark):
    assert phrases.mine(empty(spark)).collect() == []
    assert phrases.mine(docs(spark, [(1, None, None, None), (2, " \n", "en", None), (3, "one word", "en", None)])).collect() == []


def test_counts_beyond_64_bits(spark, monkeypatch):
    """1000000 * a * a passes 64 bits; the score stays exact."""
    real = phrases.counted
    monkeypatch.setattr(phrases, "counted", lambda *x: real(*x).withColumn("n", phrases.F.col("n") * 1_000_000_007))
    r = phrases.mine(docs(spark, [(1, "x y. x z. x y", "en", None)]), longest=2).where("phrase = 'x y'").first()
    assert (r.a, r.l, r.r, r.score) == (2 * 1_000_000_007, 3 * 1_000_000_007, 2 * 1_000_000_007, 666_666)


# importance


def plain_importance(rows, target, percent=5, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    own = [(i, *features(x)) for i, x in rows]
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_importance(spark, percent):
    rows = [*ROWS, *((1000 + i, text(15 + i % 9, i), "en", None) for i in range(60))]
    target = [text(100, 5), None, "", "ÉCOLE 42 École"]
    got = importance.importance(docs(spark, rows), docs(spark, [(i, t, None, None) for i, t in enumerate(target)]), percent=percent)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_importance([(r[0], r[1]) for r in rows], target, percent)


def test_ring_over_block_borders(monkeypatch):
    w = [b"a", b"bc", b"\xc3\xa9", b"d"] * 5
    want = sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(importance, "BLOCK_WORDS", block)
        assert sorted(np.concatenate([*importance.ring(w, 4)]).tolist()) == want
    assert [*importance.ring([])] == []


def test_importance_of_nothing(spark):
    assert importance.importance(empty(spark), empty(spark)).collect() == []
    assert {r.weight for r in importance.importance(docs(spark), empty(spark)).where("n_words = 0").collect()} == {0}


def test_resample_keeps_columns(spark):
    d = docs(spark)
    out = importance.resample(d, d.limit(2), percent=50)
    ids = {r.doc_id for r in importance.importance(d, d.limit(2), percent=50).where("rank IS NOT NULL").collect()}
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == ids


# language model


def plain_ppm(train, text_):
    """log10 probability under frozen counts, by dicts and sets."""
    order, end = lm_scoring.ORDER, b"\xff"
    seen = defaultdict(Counter)
    for t in train:
        whole = end * order + (t or "").encode().lower() + end
        for i in range(order, len(whole)):
            for k in range(order + 1):
                seen[whole[i - k : i]][whole[i]] += 1
    out, whole = 0.0, end * order + (text_ or "").encode().lower() + end
    for i in range(order, len(whole)):
        excluded = set()
        for k in range(order, -1, -1):
            after = {x: n for x, n in seen.get(whole[i - k : i], {}).items() if x not in excluded}
            if not after:
                continue
            weight = sum(after.values()) + len(after)
            if whole[i] in after:
                out += math.log10(after[whole[i]] / weight)
                break
            out += math.log10(len(after) / weight)
            excluded |= set(after)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def plain_base(train, text_):
    c = Counter()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), ""]
    for t in train:
        c.update(words(t))
    own, n = words(text_), c.total()
    return len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in own)


def folds(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    return held, [r[1] for r, h in zip(rows, held, strict=True) if not h]


@pytest.mark.parametrize("options", [{}, {"slice_grams": 100, "hot_words": 5}])
def test_lm_scoring(spark, options):
    rows = [*ROWS[:10], *ROWS[11:], *((1000 + i, text(10 + i, i), "en", None) for i in range(30)), (50, "zqj" * 15 + " Ünseen \x01", "xx", None)]
    held, train = folds(rows)
    d = docs(spark, rows)
    model = lm_scoring.train(d, **options)
    assert (len(model.cuts) > 2) == bool(options)
    got = sorted(map(tuple, lm_scoring.score(d, model).collect()), key=repr)
    want = sorted(((r[0], h, *plain_base(train, r[1]), plain_ppm(train, r[1])) for r, h in zip(rows, held, strict=True)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_probabilities_add_up_to_one():
    """After any context, over all 256 bytes, with exclusion."""
    texts = [t.encode() for _, t, *_ in ROWS if t and len(t) < 3000]
    key = np.concatenate([k for k, _ in lm_scoring.runs(texts)])
    gram, n = lm_scoring.summed(key, np.ones(len(key)))
    trie = lm_scoring.Trie(gram, n, *lm_scoring.summed(gram % lm_scoring.ALL, n))
    contexts = [*np.unique(key >> 8)[:50].tolist(), int.from_bytes(b"zqzq", "big"), int.from_bytes(b"\xffthe", "big")]
    p = 10 ** trie.log10(np.array([c << 8 | b for c in contexts for b in range(256)])).reshape(-1, 256)
    assert np.allclose(p.sum(axis=1), 1)


def test_long_texts_are_coded_by_the_slice(monkeypatch):
    texts = [b"x", text(300, 1).encode(), None, b"", text(90, 2).encode()]
    whole = [np.concatenate(x) for x in zip(*lm_scoring.runs(texts))]
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 100)
    parts = [np.concatenate(x) for x in zip(*lm_scoring.runs(texts))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == sum(len(t or b"") + 1 for t in texts)


def test_nothing_learnt(spark):
    d = docs(spark, [(7, "ab", None, None)])
    r = lm_scoring.score(d, lm_scoring.train(empty(spark))).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and np.isclose(r.score, -3 * math.log10(256))
    assert lm_scoring.score(empty(spark), lm_scoring.train(d)).collect() == []


def test_adaptive(spark):
    """Repetition gets cheap; each byte is coded before it is learnt."""
    assert np.isclose(lm_scoring.adaptive_score(b""), -math.log10(256))
    assert np.isclose(lm_scoring.adaptive_score(b"a"), -math.log10(256) + math.log10(1 / 2) - math.log10(255))
    assert lm_scoring.adaptive_score(b"abcabc" * 50) > lm_scoring.adaptive_score(text(60, 1).encode()[:300])
    d = docs(spark, [r for r in ROWS if len(r[1] or "") < 3000])
    assert {(r.doc_id, r.score) for r in lm_scoring.adaptive(d).collect()} == {(r.doc_id, lm_scoring.adaptive_score((r.text or "").encode())) for r in d.collect()}

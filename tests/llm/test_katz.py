import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mapweave.llm import katz


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order=katz.ORDER):
        self.words, self.runs, self.after, self.order = Counter(), [Counter() for _ in range(order + 1)], defaultdict(set), order
        for t in texts:
            self.words.update(t)
            for i, w in enumerate(t):
                for h in self.histories(t, i):
                    self.runs[len(h) + 1][*h, w] += 1
                    self.after[h].add(w)
        self.n = sum(self.words.values())
        few = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
        self.d1, self.d = katz.good_turing(few(self.words)), [katz.good_turing(few(c)) for c in self.runs]
        left = sum(v * (1 - self.d1[v]) for v in self.words.values() if v <= 5)
        if self.n and left <= 0:
            self.total, self.unseen, self.d1 = self.n + 1, 1 / (self.n + 1), np.ones(6)
        else:
            self.total, self.unseen = max(self.n, 1), left / self.n if self.n else 1.0
        self.weights = {}

    def histories(self, t, i):
        """All histories of a token, the longest last."""
        whole = ("START", *t[:i])
        return [whole[len(whole) - k :] for k in range(1, min(self.order, len(whole) + 1))]

    def word(self, w):
        c = self.words[w]
        return self.unseen if not c else c * (self.d1[c] if c <= 5 else 1) / self.total

    def weight(self, h):
        if h not in self.weights:
            runs, d, seen = self.runs[len(h) + 1], self.d[len(h) + 1], self.after[h]
            total = sum(runs[*h, x] for x in seen)
            left = sum(runs[*h, x] * (1 - d[runs[*h, x]]) for x in seen if runs[*h, x] <= 5)
            total, left = (total + 1, 1) if left < 1e-9 else (total, left)
            self.weights[h] = total, left / total / (1 - sum(self.p(h[1:], x) for x in seen))
        return self.weights[h]

    def p(self, h, w):
        if not h:
            return self.word(w)
        if h not in self.after:
            return self.p(h[1:], w)
        total, backoff = self.weight(h)
        c = self.runs[len(h) + 1][*h, w]
        return c * (self.d[len(h) + 1][c] if c <= 5 else 1) / total if c else backoff * self.p(h[1:], w)

    def score(self, t):
        return sum(math.log10(self.p(self.histories(t, i)[-1], w)) for i, w in enumerate(t))


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def rows():
    r = np.random.default_rng(4)
    vocab = [f"W{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    texts = [" ".join(r.choice(vocab, r.integers(1, 60), p=p / p.sum())) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "null key"), (502, "twice over"), (502, "twice over"), (503, "A a É é " * 9000), (2, "unheard-of wörds here")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def compare(spark, data, order=katz.ORDER):
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, held string")
    got = sorted(((r.doc_id, r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score_texts(df, order=order).collect()), key=str)
    model = Plain([tokens(t) for i, t in data if not held(i)], order)
    want = []
    for i, t in data:
        own = tokens(t)
        base = sum(math.log10((model.words[w] + 1) / (model.n + len(model.words) + 1)) for w in own)
        want.append((i, len(own), held(i), sum(model.words[w] > 0 for w in own), model.n, base, model.score(own)))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_dictionaries(spark, order):
    model = compare(spark, rows(), order)
    longest = [r[:-1] for r, _ in model.runs[order].most_common(8)]
    for h in [("START",), ("w0",), ("w7",), ("twice",), ("nowhere",), ("w0", "nowhere")[: order - 1], *longest]:
        assert sum(model.p(h, w) for w in model.words) + model.p(h, "unseen-word") == pytest.approx(1, abs=1e-9)


def test_many_chunks_and_partitions(spark, monkeypatch):
    """Small parts, so that words and contexts are spread over partitions."""
    for name, value in (("CHUNK", 500), ("WORDS", 50), ("PAIRS", 700), ("RUNS", 600)):
        monkeypatch.setattr(katz, name, value)
    monkeypatch.setattr(katz, "max", lambda *x: max(*[100 if y == 10_000 else y for y in x]) if len(x) > 1 else max(*x), raising=False)
    compare(spark, rows() + [(600 + i, "the end of the line") for i in range(300)])


def test_degenerate(spark):
    compare(spark, [(1, "only one text")])
    compare(spark, [(2, t) for t in ("a b", "c")] + [(9, "x")])
    held_only = [i for i in range(100) if held(i)][:3]
    compare(spark, [(i, "all held out") for i in held_only])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_texts(empty).count() == 0


def test_a_large_chunk(spark):
    """Numbers of words whose pairs pass 32 bits."""
    compare(spark, [(i, " ".join(f"v{(i * 7919 + k * k) % 90_000}" for k in range(9000))) for i in range(12)])


def test_arrays_and_names_come_back():
    r = np.random.default_rng(6)
    for a in (np.zeros(0, np.uint64), np.zeros(5, np.int64), r.integers(-9, 1 << 40, 999), r.random(50), np.array([0, 255, 256], np.uint32), np.array([1, 0], np.uint8)):
        assert (katz.release(katz.squeeze(a), a.dtype.type) == a).all() and len(katz.release(katz.squeeze(a), a.dtype.type)) == len(a)
    for a in (np.array([katz.START]), np.array([0, 0, 5, 5, 1 << 32, (1 << 32) + 7, katz.START], np.uint64), np.sort(r.integers(0, 1 << 64, 5000, np.uint64)), np.sort(r.integers(0, 1 << 34, 5000).astype(np.uint64)), np.array([1, (1 << 64) - 1], np.uint64)):
        assert (katz.release_names(katz.squeeze_names(a)) == a).all()


def test_counts_beyond_32_bits(spark):
    """Three chunks in which a word occurs as often as a chunk can say."""
    words, most = np.array([7, 9], np.uint64), (1 << 32) - 1
    rows = [(i, bytearray(katz.squeeze(katz._steps(words))), bytearray(katz.squeeze(np.array([most, 1], np.uint32)))) for i in range(3)]
    table = spark.createDataFrame(rows, "chunk long, vocab binary, counts binary")
    got = katz.count_words(table, 0).collect()
    assert [katz.release(r["count"], np.int64).tolist() for r in got if r.chunk >= 0] == [[3 * most, 3]] * 3
    assert next(list(r.sums[:2]) for r in got if r.chunk < 0) == [3 * most + 3, 2]


def test_discounts_of_odd_counts():
    """Katz's form where it holds; the absolute discount where nothing occurs once, or too much occurs twice."""
    d = katz.good_turing([1000, 300, 120, 60, 35, 20])
    common = 6 * 20 / 1000
    assert d[2] == pytest.approx((3 * 120 / (2 * 300) - common) / (1 - common)) and all(0 < x < 1 for x in d[1:])
    for n in ([0, 0, 0, 0, 0, 0], [0, 5, 1, 0, 0, 0], [10, 9, 0, 0, 0, 0], [4, 0, 0, 0, 0, 0]):
        cut = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        assert katz.good_turing(n)[1:] == pytest.approx([(r - cut * 0.999) / r for r in range(1, 6)])

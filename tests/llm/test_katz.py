"""The language model against the formulas written out, and its sums to one."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codetide.llm import katz

SCHEMA = "doc_id long, text string, held_out string, kind string"
END, START = ("end",), ("start",)


class Plain:
    def __init__(self, texts):
        self.c1, self.c2, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            before = START
            for w in self.tokens(t):
                self.c1[w] += 1
                self.c2[before, w] += 1
                self.hist[before] += 1
                before = w
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.d1, self.d2 = (self.discounts(Counter(c.values())) for c in (self.c1, self.c2))
        mass = sum(self.d1(c) * c for c in self.c1.values())
        self.total = self.n if self.n - mass > 1e-9 * max(self.n, 1) else self.n + 1
        self.unknown = 1 - mass / self.total
        self.followers = {}
        for h, w in self.c2:
            self.followers.setdefault(h, []).append(w)

    @staticmethod
    def tokens(text):
        return (text or "").encode().lower().split() + [END]

    @staticmethod
    def discounts(n):
        values = {}
        if all(n[r] for r in range(1, 7)) and 6 * n[6] / n[1] < 1:
            a = 6 * n[6] / n[1]
            values = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)}
        if not values or not all(0 < x < 1 for x in values.values()):
            off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            values = {r: 1 - off / r for r in range(1, 6)}
        return lambda c: values.get(c, 1.0)

    def p1(self, w):
        c = self.c1[w]
        return self.d1(c) * c / self.total if c else self.unknown

    def p(self, h, w):
        if not self.hist[h]:
            return self.p1(w)
        seen = sum(self.d2(self.c2[h, x]) * self.c2[h, x] for x in self.followers[h])
        below = self.hist[h] + (self.hist[h] - seen <= 1e-9 * self.hist[h])
        if self.c2[h, w]:
            return self.d2(self.c2[h, w]) * self.c2[h, w] / below
        return (1 - seen / below) / (1 - sum(self.p1(x) for x in self.followers[h])) * self.p1(w)

    def score(self, text):
        before, out = START, 0.0
        for w in self.tokens(text):
            out += math.log10(self.p(before, w))
            before = w
        return out


def corpus(n=160):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "x|y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(words, weights, k=rng.randrange(0, 60))).title()) for i in range(n)]
    rows += rows[:5] + [(7000, None), (7001, ""), (7002, " \t"), (None, "w1 w2 only here"), (7003, "the " * 20_000)]
    return rows


def check(rows, got):
    held = lambda i: zlib.crc32((str(i) if i is not None else "null").encode()) % 7 == 2
    model = Plain([t for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], r)
    for i, text in rows:
        r, tokens = by_id[i], model.tokens(text)
        assert r["held_out"] == held(i) and r["n_tokens"] == len(tokens) and r["train_tokens"] == model.n
        assert r["n_known"] == sum(model.c1[w] > 0 for w in tokens)
        assert r["base_score"] == pytest.approx(sum(math.log10((model.c1[w] + 1) / (model.n + model.v + 1)) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(model.score(text), rel=1e-9, abs=1e-12)
    return model


@pytest.mark.parametrize("block_bytes,range_keys", [(8 << 20, 1 << 20), (2000, 100)])
def test_scores(shared, block_bytes, range_keys):
    rows = corpus()
    docs = shared.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = katz.scored(docs, katz.fold(F.col("doc_id"), 7) == 2, block_bytes=block_bytes, range_keys=range_keys).collect()
    model = check(rows, got)
    for h in [START, b"w0", b"w1", b"w300", b"never"]:
        known = sum(model.p(h, w) for w in model.c1)
        assert known + model.p(h, b"a word that is unknown") == pytest.approx(1, abs=1e-9)


def test_tiny_and_empty(shared):
    docs = shared.createDataFrame([(1, "a b", None, None), (2, None, None, None)], SCHEMA)
    check([(1, "a b"), (2, None)], katz.scored(docs, katz.fold(F.col("doc_id"), 7) == 2).collect())
    assert katz.scored(docs.where("false"), F.lit(False)).count() == 0
    nothing = katz.scored(docs, F.lit(True)).collect()  # no training rows: all tokens are the unknown class
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in nothing} == {(0, 0, 0.0, 0.0)}

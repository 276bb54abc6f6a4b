"""Importance resampling and the factorization machine: plain versions, held-out accuracy, edge cases."""

import collections
import math
import random
import zlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetide.llm import importance, katz, toxicity

DOCS = "doc_id long, text string, label string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    words = ["and", "the", "Rain", "over", "hills,", "was", "long.", "we", "saw", "it"] + [f"word{c}" for c in "abcdefghij"]
    return " ".join(rng.choices(words, k=n))


def quality_rows(seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randrange(20, 80))
        bad = i % 5 == 0
        if bad:
            text = " ".join(w.upper() + "!!" if i % 2 else w + rng.choice(["###", "$$$"]) for w in text.split())
        rows.append((i, text))
        if i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (0, rows[0][1]), (None, prose(rng, 30)), (1003, prose(rng, 4_000))]
    return rows, labels + [(None, 1, 0), (1, None, None), (5000, 1, 0)]


def plain_form(word):
    out = re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", word.encode())))
    return re.sub(rb"(.)\1+", rb"\1", out, flags=re.S)


def test_importance_weights_and_draw(shared):
    rows, labels = quality_rows()
    docs = shared.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)
    marks = shared.createDataFrame(labels, LABELS)
    got = importance.scored(docs, marks, bits=22).collect()  # so many buckets that no two n-grams share one
    assert len(got) == len(rows)
    # The same ratios with exact n-grams in place of buckets.
    def grams(text):
        words = (text or "").split()
        forms = [(plain_form(w), k > 0 and words[k - 1] == w) for k, w in enumerate(words)]
        return forms + list(zip(forms, forms[1:]))

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    total, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        total.update(grams(t))
        if i in good:
            target.update(grams(t))
    size = 1 << 22
    everything, wanted = sum(total.values()), sum(target.values())
    share = wanted / everything
    ratio = lambda g: math.log((target[g] + share) / (wanted + size * share)) - math.log((total[g] + 1) / (everything + size))
    ratios = {g: ratio(g) for g in total}
    for r, text in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        assert r["log_weight"] == pytest.approx(sum(ratios[g] for g in grams(text[1])), rel=1e-6, abs=1e-6)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not [(i, kept[i], [r["log_weight"] for r in got if r["doc_id"] == i]) for i in range(300) if kept[i] != (i % 5 != 0)]
    assert True and kept[1001] and kept[1000] and kept[None]
    drawn = sorted((r["drawn"] for r in got), reverse=True)
    k = sum(r["kept"] for r in got)
    assert {r["drawn"] for r in got if r["kept"]} == set(drawn[:k])
    chosen = importance.selected(docs, marks)
    assert chosen.columns == docs.columns and chosen.count() == k
    assert {(r["doc_id"], r["kept"]) for r in importance.scored(docs, marks, bits=22).collect()} == {(r["doc_id"], r["kept"]) for r in got}


def test_importance_without_labels_or_rows(shared):
    docs = shared.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = shared.createDataFrame([], LABELS)
    assert importance.selected(docs, none).count() == 2
    assert importance.scored(docs.where("false"), none).count() == 0


def test_kth_largest(shared):
    values = np.concatenate((np.random.default_rng(1).normal(0, 1e6, 3000), [5.0] * 50, [1e-9, -1e12]))
    frame = shared.createDataFrame([(float(v),) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 1500, 3052):
        assert importance.kth_largest(frame, "x", k) == ordered[k - 1]


def test_machine_learns_pairs():
    """Toxic only if an insult meets a group: additive weights cannot tell, pairs can."""
    rng = np.random.default_rng(5)
    n = 4000
    insult, group = rng.random(n) < 0.5, rng.random(n) < 0.5
    rows = [sorted(({0} if a else set()) | ({1} if b else set()) | set((2 + rng.integers(0, 30, 5)).tolist())) for a, b in zip(insult, group)]
    y = (insult ^ group).astype(float)
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    flat = np.concatenate([np.array(r) for r in rows])
    half = n // 2
    bias, w, v = toxicity.fit(flat[:start[half]], start[:half + 1], y[:half], 32, epochs=60)
    z, _, _ = toxicity.margins(flat[start[half]:], start[half:] - start[half], bias, w, v)
    assert ((z > 0) == y[half:]).mean() > 0.97
    linear, _, _ = toxicity.margins(flat[start[half]:], start[half:] - start[half], bias, w, v * 0)
    assert ((linear > 0) == y[half:]).mean() < 0.8


def test_margins_are_the_pair_sums():
    rng = np.random.default_rng(6)
    w, v = rng.normal(size=9), rng.normal(size=(9, 4))
    rows = [[0, 3, 8], [], [5], list(range(9))]
    start = np.cumsum([0] + [len(r) for r in rows])
    z, _, _ = toxicity.margins(np.array(sum(rows, [])), start, 0.3, w, v)
    for r, got in zip(rows, z):
        assert got == pytest.approx(0.3 + sum(w[i] for i in r) + sum(v[i] @ v[j] for i in r for j in r if i < j))


def accuracy(spark, texts, marks, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(m)) for i, m in enumerate(marks)], LABELS)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels, lambda doc: katz.fold(doc, 5) == 0, **options).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    return got, held, sum(got[i]["predicted"] == marks[i] for i in held) / len(held)


def test_insult_and_group_together(shared):
    """Neither word tells anything by itself; together they decide."""
    rng = random.Random(2)
    texts, marks = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        marks.append(int(insult != group))
    assert accuracy(shared, texts, marks)[2] > 0.97


def test_rare_and_many_telling_terms(shared):
    rng = random.Random(4)
    texts, marks = [], []
    for i in range(1250):
        bad = i % 5 == 1
        words = [f"w{rng.randrange(2000)}" for _ in range(20)] + (["plain"] if not bad else [f"slur{rng.randrange(3)}"] if i % 10 else [])
        texts.append(" ".join(words))
        marks.append(int(bad))
    for i in [i for i in range(1250) if marks[i] and zlib.crc32(str(i).encode()) % 5][:3]:
        texts[i] += " seldom"
    got, _, _ = accuracy(shared, texts + ["w1 w2 seldom", "w1 w2"], marks + [1, 0])
    assert got[1250]["score"] > got[1251]["score"]
    # 6,000 telling words, each in 16 toxic documents or 16 clean ones: all count.
    texts = [" ".join(f"{'bad' if i % 2 else 'good'}{(i // 2 * 20 + k) % 3000}" for k in range(20)) for i in range(2 * 150 * 16)]
    got, held, right = accuracy(shared, texts + [f"bad{k}" for k in range(0, 3000, 29)], [i % 2 for i in range(len(texts))] + [1] * len(range(0, 3000, 29)))
    assert right > 0.99


def test_toxicity_held_out(shared):
    rng = random.Random(7)
    insults = ["idiot", "moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(1500):
        text, bad = prose(rng, rng.randrange(3, 120)).split(), i % 8 == 0
        if bad:
            text.insert(rng.randrange(len(text) + 1), rng.choice(insults).title() + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, prose(rng, 50_000)), (None, "an idiot"), (8, rows[8][1])]
    docs = shared.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)
    marks = shared.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (6000, 1, 1)], LABELS)
    got = toxicity.scored(docs, marks, lambda doc: katz.fold(doc, 5) == 0).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500]
    right = sum(r["predicted"] == int(r["doc_id"] % 8 == 0) for r in held)
    assert len(held) > 200 and right / len(held) > 0.99
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[5000]["score"] == by_id[5001]["score"] < 0.5 and by_id[None]["predicted"] == 1 and by_id[5002]["predicted"] == 0
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    nothing = toxicity.scored(docs, marks.where("false"), lambda doc: katz.fold(doc, 5) == 0).collect()
    assert {r["predicted"] for r in nothing} == {0}
    assert toxicity.scored(docs.where("false"), marks, lambda doc: katz.fold(doc, 5) == 0).count() == 0

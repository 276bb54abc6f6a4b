"""Repeated passages against a direct count of every window."""

import hashlib
import random

import numpy as np
import pytest

from codetide.llm import substrings

SCHEMA = "doc_id long, text string, kept_text string, block string"


def plain(rows):
    first, out = {}, []
    for i, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - 12):
            if i is not None:
                key = tuple(words[p:p + 13])
                first[key] = min(first.get(key, i), i)
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - 12):
            if i is not None and first[tuple(words[p:p + 13])] < i:
                gone.update(range(p, p + 13))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", "the", "THE"]
    fresh = lambda n: rng.choices(words, k=n)
    passages = [fresh(n) for n in (13, 14, 20, 60, 12)] + [["same"] * 40, ["a", "b"] * 20, ["a"] * 7 + ["b"] * 9 + ["a"] * 5]
    rows = [(1000 + i, None) for i in range(2)] + [(900, ""), (901, " \n\t")]
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts += fresh(rng.randrange(0, 40)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        rows.append((rng.randrange(0, 10_000), rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += rows[10:14] + [(None, rows[20][1]), (None, rows[21][1])]  # repeated rows, null ids
    rows.append((50_000, " ".join(["the"] * 30_000)))
    rows.append((50_001, " ".join(["the"] * 100)))
    return rows


@pytest.mark.parametrize("block_bytes,range_keys", [(8 << 20, 1 << 20), (3000, 200)])
def test_removed_words(shared, block_bytes, range_keys):
    rows = corpus()
    docs = shared.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = substrings.repeated(docs, block_bytes=block_bytes, range_keys=range_keys)
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == plain(rows)
    clean = substrings.cleaned(docs, block_bytes=block_bytes, range_keys=range_keys)
    assert clean.columns == docs.columns
    seen = [(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in clean.collect()]
    assert sorted(seen, key=repr) == sorted([(r[0], r[3]) for r in plain(rows)], key=repr)


def test_empty_tables(shared):
    docs = shared.createDataFrame([], SCHEMA)
    assert substrings.repeated(docs).count() == 0
    assert substrings.cleaned(docs).count() == 0


def test_equal_windows_have_equal_symbols():
    """Whatever surrounds a window, the symbols that it fixes are the same, and mostly there are some."""
    rng = np.random.default_rng(4)
    for alphabet in (2, 3, 10, 100):
        window = rng.integers(1, alphabet + 1, 13)
        seen = set()
        for _ in range(40):
            before, after = rng.integers(1, alphabet + 1, 30), rng.integers(1, alphabet + 1, 30)
            cut = rng.integers(0, 31)
            s = np.concatenate(([0], before[cut:], window, after[:rng.integers(0, 31)], [0])).astype(np.uint64)
            start = 31 - cut
            name, begin, since, until = substrings.fixed_symbols(substrings.blocks.mix(s), s == 0)
            inside = (since >= start) & (until <= start + 13)
            seen.add(frozenset(zip(name[inside].tolist(), (begin[inside] - start).tolist())))
            alone = rng.random(len(name)) < 0.3
            expected = not (inside & alone).any()
            assert substrings.possible(np.array([start]), since[alone], until[alone], len(s))[0] == expected
        assert len(seen) == 1 and len(seen.pop()) > 0

"""SimHash groups against all pairs, also where every key is a crowded one."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codetide.llm import simhash
from codetide.llm.components import connected
from codetide.session import Stages

SCHEMA = "doc_id long, text string, source string, fp string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(fps)):
        members.setdefault(find(i), []).append(ids[i])
    return [min(members[find(i)]) for i in range(len(fps))]


def texts():
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    out = ["", None, " \t\n", "one", "One two", "a b c", "a  b\nc", "x " * 30_000]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(30)]
    for b in base:
        out += [b, b.upper().replace("É", "é"), b + " tail", b.replace("w7é", "w8é")]
    return out


@pytest.mark.parametrize("bucket", [256, 1])
def test_groups(shared, bucket):
    values = texts()
    ids = list(range(100, 100 + len(values)))
    random.Random(1).shuffle(ids)
    docs = shared.createDataFrame([(i, t, "s", "clash") for i, t in zip(ids, values)], SCHEMA)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    fps = [plain_fingerprint(t) for t in values]
    expected = {i: (f"{fp:016x}", c) for i, fp, c in zip(ids, fps, plain_groups(ids, fps))}
    assert got == expected
    kept = simhash.deduplicated(docs, bucket=bucket)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in expected.values()})


@pytest.mark.parametrize("bucket", [256, 1])
def test_links_within_two_bits(shared, bucket):
    """Clusters of random fingerprints around a centre: same components as all pairs."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(40):
        centre = int(rng.integers(0, 1 << 63))
        fps.add(centre)
        for _ in range(8):
            value = centre
            for bit in rng.choice(64, size=rng.integers(1, 5), replace=False):
                value ^= 1 << int(bit)
            fps.add(value)
    fps = sorted(fps)
    frame = shared.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    stages = Stages(shared)
    roots = connected(simhash.links(frame, stages.keep, bucket), stages.keep).collect()
    signed = [simhash._signed(f) for f in fps]
    groups = dict(zip(signed, plain_groups(signed, fps)))
    found = {r["node"]: r["root"] for r in roots}
    assert {f: found.get(f, f) for f in signed} == groups


def test_repeated_rows_null_ids_and_empty_table(shared):
    docs = shared.createDataFrame(
        [(1, "a b c d", "s", "x"), (1, "a b c d", "s", "x"), (2, "a b c d", None, None), (None, "a b c d", None, None), (None, "other words are here", None, None)], SCHEMA)
    rows = simhash.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted(((r[0] or -1), (r[1] or -1)) for r in rows) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted(r["text"] for r in simhash.deduplicated(docs).collect()) == ["a b c d", "other words are here"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.deduplicated(docs.where(F.lit(False))).count() == 0


def test_long_chain(shared):
    stages = Stages(shared)
    chain = shared.range(0, 300).selectExpr("id AS a", "id + 1 AS b")
    star = shared.range(1000, 1200).selectExpr("id AS a", "1000L AS b")
    roots = {r["node"]: r["root"] for r in connected(chain.union(star), stages.keep).collect()}
    assert roots == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}

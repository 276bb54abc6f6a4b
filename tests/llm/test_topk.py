import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetide.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def plain(rows, k=5, every=50):
    seen = {}
    for i, x in rows:
        if i is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        y = [math.floor(256 * float(np.float32(v))) for v in x]
        seen[i] = min(seen.get(i, y), y)
    out = []
    for q, x in seen.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in seen.items() if i != q and len(y) == len(x))
            out += [(q, r, i, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_block", [(8192, 512), (40, 3)])
def test_nearest(shared, shard_rows, query_block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [rows[0], rows[1], (2, [9.0] * 16), (None, [0.1] * 16), (2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16),
             (2150, [float("inf")] + [0.0] * 15), (2200, []), (2201, []), (2250, [1.0, 2.0]), (2251, [-1.0, 2.0]), (2300, [3.0] * 3)]
    docs = shared.createDataFrame([(i, x, "clash", "clash") for i, x in rows], SCHEMA)
    got = topk.nearest(docs, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_block=query_block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


@pytest.mark.parametrize("wave", [2, 8])
def test_waves_of_shards(shared, wave):
    """Some 30 shards in several waves, with ties across shards and fewer than five other rows in one length."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 3).tolist()) for i in range(300)] + [(1000 + 50 * i, [1.0 * i, 2.0]) for i in range(4)]
    docs = shared.createDataFrame([(i, [float(v) for v in x], "clash", "clash") for i, x in rows], SCHEMA)
    got = topk.nearest(docs, F.col("vec_id") % 50 == 0, shard_rows=10, query_block=2, wave=wave)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_large_components_and_empty(shared):
    rows = [(0, [1e6, 3e7]), (1, [2e6, -1e7]), (2, [1e7, 1e7]), (50, [-3e7, 2e6])]
    docs = shared.createDataFrame([(i, x, None, None) for i, x in rows], SCHEMA)
    assert sorted(map(tuple, topk.nearest(docs, F.col("vec_id") % 50 == 0).collect())) == plain(rows)
    assert topk.nearest(docs.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_bound_prunes():
    """A search with the k-th score known in advance visits few leaves of clustered rows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (40, 8))
    rows = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 2, (4000, 8)))
    tree = topk.BallTree(np.arange(4000), rows)
    tree.arrays()
    q = rows[17]
    scores = sorted(((int(s), -i) for i, s in enumerate(rows @ q) if i != 17), reverse=True)[:5]
    assert sorted(((s, -i) for s, i in tree.search(17, q, 5, -np.inf, True)), reverse=True) == scores
    assert len(tree.search(17, q, 5, scores[0][0] + 1, True)) == 0

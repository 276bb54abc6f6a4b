"""Embedders that need no model."""

import hashlib
import time
from collections import Counter

from codetide import hooks


def test_digest_embedder_counts_every_token(spark):
    texts = ["a b A", "", None, "É é _x9 -", "!?", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    place = lambda token: int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 7
    tokens = [["a", "b", "a"], [], [], ["É", "é", "_x9"], [], ["a"]]
    want = {i: [float(Counter(map(place, found))[p]) for p in range(7)] if found else [] for i, found in enumerate(tokens)}
    embedded = hooks.digest_embedder(7)(rows)
    assert embedded.columns == ["id", "content", "embedding"]
    assert {r.id: r.embedding for r in embedded.collect()} == want
    assert {r.id for r in embedded.where("size(embedding) > 0").collect()} == {0, 3, 5}


def test_digest_embedder_is_linear_in_tokens(spark):
    """Not tokens times width: 40,000 tokens a text and 4,096 places."""
    texts = spark.range(0, 8, 1, 1).selectExpr("array_join(transform(sequence(1, 40000), x -> concat('w', (x + id) % 900)), ' ') AS content")
    start = time.perf_counter()
    rows = hooks.digest_embedder(4096)(texts).selectExpr("aggregate(embedding, 0D, (a, x) -> a + x) AS n").collect()
    assert [r.n for r in rows] == [40000.0] * 8 and time.perf_counter() - start < 10

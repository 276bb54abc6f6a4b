"""Exact top-k against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codetide.functions import vectors
from codetide.operators import retrieval, similarity

VECTORS = "repo string, id string, ord bigint, embedding array<double>"


def unit(m):
    return m / (np.linalg.norm(m, axis=-1, keepdims=True) + 1e-8)


def brute_force(chunks, queries, k):
    want = {}
    for repo, qid, q in queries:
        scored = [
            (-round(float(unit(np.array(v)) @ unit(np.array(q))), 12), o, i)
            for r, i, o, v in chunks if r == repo and v and len(v) == len(q)]
        want[(repo, qid)] = [i for _, _, i in sorted(scored)[:k]]
    return want


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_top_k_matches_brute_force(spark, monkeypatch, block_rows):
    """One repository holds most vectors, a third of all vectors are copies of one, some are missing."""
    rng = np.random.default_rng(5)
    copy = rng.normal(size=8).tolist()
    chunks = []
    for i in range(300):
        repo = "hot" if i % 10 < 8 else f"r{i % 3}"
        vector = copy if i % 3 == 0 else rng.normal(size=8).tolist()
        chunks.append((repo, f"c{i}", i, [] if i % 50 == 7 else vector))
    chunks.append(("hot", "zero", 300, [0.0] * 8))
    chunks.append(("hot", "narrow", 301, [1.0, 0.0]))
    queries = [("hot" if i % 4 else "r1", f"q{i}", copy if i == 5 else rng.normal(size=8).tolist()) for i in range(40)]
    monkeypatch.setattr(similarity, "CHUNK_BLOCK_ROWS", block_rows)
    monkeypatch.setattr(similarity, "QUERY_BLOCK_ROWS", block_rows)
    hits = similarity.top_k(
        spark.createDataFrame(chunks, VECTORS).repartition(5),
        spark.createDataFrame(queries, "repo string, query_id string, embedding array<double>"), 5, chunk_ord="ord").collect()
    got = {}
    for h in sorted(hits, key=lambda h: h["rank"]):
        got.setdefault((h.repo, h.query_id), []).append(h.id)
    assert got == brute_force(chunks, queries, 5)


def test_filter_applies_before_ranking(spark):
    rows = [("r", "a", "x", [1.0, 0.0]), ("r", "b", "y", [0.9, 0.1]), ("r", "c", "y", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "repo string, id string, chunk_type string, embedding array<double>")
    queries = spark.createDataFrame([("r", "q", [1.0, 0.0])], "repo string, query_id string, embedding array<double>")
    hits = similarity.top_k(chunks, queries, 1, where="chunk_type = 'y'").collect()
    assert [(h.id, h["rank"]) for h in hits] == [("b", 1)]


def test_nearest(spark):
    names = {"near": [1.0, 0.0, 0.0], "close": [0.9, 0.1, 0.0], "far": [0.0, 0.0, 1.0]}
    rows = [(n, v + [0.0] * 765) for n, v in names.items()]
    chunks = spark.createDataFrame(rows, "name string, embedding array<double>")
    found = similarity.with_distance(similarity.nearest(chunks, [1.0] + [0.0] * 767, 2, tie_breakers=["name"])).collect()
    assert [r.name for r in found] == ["near", "close"]
    assert found[0].distance == pytest.approx(0.0, abs=1e-6)


def test_nearest_among_copies(spark):
    """All rows tie: the tie breaker decides, across batches and tasks."""
    chunks = spark.range(5000).selectExpr("id", "array(1D, 2D) AS embedding").repartition(7)
    assert [r.id for r in similarity.nearest(chunks, [1.0, 2.0], 3, tie_breakers=["id"]).collect()] == [0, 1, 2]


def test_cosine_expression(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for _ in range(20)] + [([0.0] * 5, [1.0] * 5)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [float(unit(np.array(a)) @ unit(np.array(b))) for a, b in rows], atol=1e-11)


def test_context_excludes_changed_files_after_the_search(spark):
    rows = [("r", f"f{i}.py", 0, "full_file", f"f{i}.py", f"text {i}", [1.0, i / 10.0]) for i in range(8)]
    chunks = spark.createDataFrame(
        rows, "repo string, file_path string, chunk_index bigint, chunk_type string, name string, content string, embedding array<double>")
    asked = spark.createDataFrame([("r", 1, [1.0, 0.0]), ("empty", 2, [1.0, 0.0])], "repo string, pr_id bigint, embedding array<double>")
    files = spark.createDataFrame(
        [("r", 1, "f0.py"), ("r", 1, "f2.py"), ("r", 1, "f3.py"), ("empty", 2, "x.py"), ("r", 3, "f1.py")],
        "repo string, pr_id bigint, file_path string")
    rows = retrieval.retrieve_context(chunks, asked, files).orderBy("rank").collect()
    assert [(r.pr_id, r["rank"], r.file, r.content) for r in rows] == [(1, 1, "f1.py", "text 1"), (1, 2, "f4.py", "text 4")]
    status = {r.pr_id: r.status for r in retrieval.retrieval_status(files, chunks, asked).collect()}
    assert status == {1: "searched", 2: "needs_indexing", 3: "no_vector"}


def blocks(df):
    return similarity._blocks(similarity._vectors(df, "id", "ord"), 1024).selectExpr("repo", "size(ids) AS n").collect()


def test_blocks_follow_repositories(spark):
    """Small repositories have one block each; a hot one has full ones, in several tasks."""
    vectors_of = lambda n, repo: spark.range(0, n, 1, 16).selectExpr(f"{repo} AS repo", "cast(id AS string) AS id", "id AS ord", "array(double(id), 1D) AS embedding")
    many = blocks(vectors_of(20_000, "concat('r', id % 2000)"))
    assert sum(b.n for b in many) == 20_000 and len({b.repo for b in many}) == 2000 and len(many) <= 2000 + 16
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = similarity._blocks(similarity._vectors(vectors_of(30_000, "if(id % 3 = 0, concat('r', id % 40), 'hot')"), "id", "ord"), 1024)
        found = hot.selectExpr("repo", "size(ids) AS n", "spark_partition_id() AS task").where("repo = 'hot'").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {b.task for b in found}
    assert sum(b.n for b in found) == 20_000 and len(tasks) > 3 and len(found) <= 20_000 / 1024 + 1 + len(tasks)


def test_hits_have_their_fields(spark):
    rows = [("r", f"f{i}.py", "full_file", f"n{i}", f"text {i}", f"f{i}.py:0", [1.0, float(i)]) for i in range(4)]
    chunks = spark.createDataFrame(rows, "repo string, file_path string, chunk_type string, name string, content string, id string, embedding array<double>")
    asked = spark.createDataFrame([("r", "q", [1.0, 0.0])], "repo string, query_id string, embedding array<double>")
    hits = similarity.with_fields(similarity.top_k(chunks, asked, 2), chunks).orderBy("rank").collect()
    assert [(h.file_path, h.chunk_type, h.name, h.content) for h in hits] == [(f"f{i}.py", "full_file", f"n{i}", f"text {i}") for i in range(2)]
    assert hits[0].distance == pytest.approx(0.0, abs=1e-6) and hits[1].distance == pytest.approx(1 - 2 ** -0.5, abs=1e-6)


def test_later_blocks_return_only_what_may_enter():
    """Block pairs of one repository as a task meets them: exact with many ties, one product narrow, and few rows leave it."""
    rng = np.random.default_rng(3)
    chunks = unit(np.concatenate([rng.normal(size=(5000, 16)), np.tile(rng.normal(size=(2, 16)), (500, 1))]))
    queries = unit(np.concatenate([rng.normal(size=(48, 16)), chunks[5000:5002]]))
    schema = pa.schema([("repo", pa.string()), ("dim", pa.int32()), ("ids", pa.list_(pa.string())), ("ords", pa.list_(pa.int64())), ("matrix", pa.binary()),
                        ("query_ids", pa.list_(pa.string())), ("query_matrix", pa.binary())])
    pairs = [{
        "repo": "r", "dim": 16, "ids": [str(i) for i in range(s, s + 250)], "ords": list(range(s, s + 250)), "matrix": chunks[s:s + 250].tobytes(),
        "query_ids": [str(q) for q in range(50)], "query_matrix": queries.tobytes()} for s in range(0, 6000, 250)]
    hits = pa.Table.from_batches(vectors.score_block_pairs(5)([pa.RecordBatch.from_pylist(pairs, schema)])).to_pylist()
    assert len(hits) < 50 * 5 * len(pairs) / 3
    for q in range(50):
        got = sorted((-h["similarity"], h["ord"]) for h in hits if h["query_id"] == str(q))[:5]
        want = np.lexsort((np.arange(6000), -np.round(np.einsum("j,ij->i", queries[q], chunks), 12)))[:5]
        assert [o for _, o in got] == want.tolist()

"""Chunking and index maintenance."""

import pytest
from pyspark.sql import functions as F

from codetide import hooks, schemas
from codetide.functions import text
from codetide.operators import indexing
from codetide.plans import index_run
from codetide.sources import index_store

EMBED = hooks.hashing_embedder(dimensions=16)


def files_df(spark, rows):
    return spark.createDataFrame([(r, p, len(c.encode()) if c is not None else 5, c) for r, p, c in rows], schemas.REPO_FILES)


def outcome(stats):
    return {r.repo: (r.indexed, r.skipped, r.errors) for r in stats.collect()}


def test_content_hash(spark):
    import hashlib
    df = spark.createDataFrame([("def foo(): pass é",)], "c string")
    assert df.select(text.content_hash(F.col("c"))).first()[0] == hashlib.sha256("def foo(): pass é".encode()).hexdigest()[:16]


@pytest.mark.parametrize("n_lines, trailing", [(0, False), (1, False), (50, False), (51, True), (230, True)])
def test_blocks_rejoin_to_the_file(spark, n_lines, trailing):
    content = "\n".join(f"line {i} " + "x" * 100 for i in range(n_lines)) + ("\n" if trailing else "")
    rows = indexing.chunk_files(files_df(spark, [("o/r", "a.md", content)])).orderBy("seq").collect()
    assert "\n".join(r.content for r in rows) == content
    if len(content) < 4000:
        assert [(r.chunk_type, r.name) for r in rows] == [("full_file", "a.md")]
    else:
        n = len(content.split("\n"))
        assert [(r.chunk_type, r.name) for r in rows] == [
            ("code_chunk", f"a.md:L{s + 1}-{min(s + 50, n)}") for s in range(0, n, 50)]


def test_summary_chunk_comes_first(spark):
    rows = indexing.chunk_files(files_df(spark, [("o/r", "a.py", "def f():\n    g()\n")])).orderBy("seq").collect()
    assert [(r.seq, r.chunk_type) for r in rows] == [(0, "file_summary"), (1, "full_file")]
    assert rows[0].content == "File: a.py\n\nLanguage: python\nFunctions: f\nCalls: g"


def test_numbering_of_many_chunks_and_failures(spark):
    """A file of 300,000 chunks, every third of which failed; no list is gathered."""
    big = spark.range(300_000).selectExpr("'r' AS repo", "'a' AS file_path", "id AS seq", "IF(id % 3 = 1, NULL, array(1D)) AS embedding")
    small = spark.range(50).selectExpr("'r' AS repo", "'b' AS file_path", "id AS seq", "array(1D) AS embedding")
    numbered = indexing.number_valid_chunks(big.union(small).repartition(8))
    assert "collect_list" not in numbered._jdf.queryExecution().toString()
    wrong = numbered.where("chunk_index <> IF(file_path = 'b', seq, seq - (seq + 1) div 3)").count()
    assert wrong == 0 and numbered.count() == 200_050


def test_contents_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [("o/r", f"f{i}.md", f"text {i}") for i in range(50)]
    files_df(spark, rows).write.parquet(path)
    files = spark.read.parquet(path)
    hashed = spark.createDataFrame(indexing.hashed_keys(files).collect(), indexing.hashed_keys(files).schema)
    ledger = hashed.drop("decodable").where("file_path < 'f3'")
    first = indexing.contents_of(files, hashed, indexing.changed_keys(hashed, ledger.where("false")), nothing_indexed=True)
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString() and first.count() == 50
    changed = indexing.changed_keys(hashed, ledger)
    update = indexing.contents_of(files, hashed, changed, nothing_indexed=False)
    plan = update._jdf.queryExecution().executedPlan().toString()
    # What is shuffled are keys of the ledger's join; contents meet a broadcast.
    scan = plan[plan.index("BroadcastExchange"):]
    assert "BroadcastHashJoin" in plan.split("BroadcastExchange")[0] and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "content#" not in scan
    assert {r.file_path for r in update.collect()} == {r.file_path for r in changed.collect()} and update.count() == 27
    moved = indexing.contents_of(files, hashed, changed, nothing_indexed=False, broadcast_marks=0)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, update.collect()))


def test_files_listed_twice(spark, tmp_path):
    """Of several versions in one run a readable one with the largest hash is indexed, once."""
    path = str(tmp_path / "index")
    rows = [("o/r", "a.md", "one"), ("o/r", "a.md", "two"), ("o/r", "a.md", "two"), ("o/r", "a.md", None), ("o/r", "b.md", "b"), ("o/r", "b.md", "b")]
    want = max(("one", "two"), key=lambda c: __import__("hashlib").sha256(c.encode()).hexdigest())
    for run in ({"o/r": (2, 0, 0)}, {"o/r": (0, 2, 0)}):
        assert outcome(index_run.run_index(spark, path, files_df(spark, rows), EMBED)) == run
        assert sorted((r.file_path, r.content) for r in index_store.load_index(spark, path)[0].collect()) == [("a.md", want), ("b.md", "b")]


def test_numbering_skips_failed_chunks(spark):
    rows = [("r", "a", i, "t", "n", "c", [1.0] if i not in (1, 3) else []) for i in range(5)] + [("r", "b", 0, None, None, "c", None)]
    df = spark.createDataFrame(
        rows, "repo string, file_path string, seq bigint, chunk_type string, name string, content string, embedding array<double>")
    got = indexing.to_index_rows(indexing.number_valid_chunks(df))
    assert sorted((r.file_path, r.chunk_index) for r in got.collect()) == [("a", 0), ("a", 1), ("a", 2)]


def test_full_run_outcomes_and_rerun(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [
        ("o/r", "a.py", "def f(): pass"), ("o/r", "b.md", "text"), ("o/r", "c.png", "binary"), ("o/r", "node_modules/x.js", "x"),
        ("o/r", "bad.py", None), ("o/r", "big.py", "x" * 102401), ("o/r", "blank.md", "   "), ("o/s", "a.py", "def f(): pass")]
    files = files_df(spark, rows)
    assert outcome(index_run.run_index(spark, path, files, EMBED)) == {"o/r": (2, 3, 1), "o/s": (1, 0, 0)}
    first = {(r.repo, r.file_path, r.chunk_index) for r in index_store.load_index(spark, path)[0].collect()}
    # Nothing changed: nothing is indexed, the table stays.
    assert outcome(index_run.run_index(spark, path, files, EMBED)) == {"o/r": (0, 5, 1), "o/s": (0, 1, 0)}
    assert {(r.repo, r.file_path, r.chunk_index) for r in index_store.load_index(spark, path)[0].collect()} == first
    stats = {r.repo: (r.total_chunks, r.indexed_files) for r in index_store.stats(spark, path).collect()}
    assert stats == {"o/r": (3, 2), "o/s": (2, 1)}


def test_incremental_update_and_removal(spark, tmp_path):
    path = str(tmp_path / "index")
    start = files_df(spark, [("o/r", f"f{i}.md", f"text {i}") for i in range(6)])
    index_run.run_index(spark, path, start, EMBED)
    changes = spark.createDataFrame(
        [("o/r", "f0.md", 5, "new text", "modified"), ("o/r", "f1.md", 5, "text 1", "modified"), ("o/r", "f2.md", 5, None, "removed"),
         ("o/r", "node_modules/y.js", 5, "var a", "added"), ("o/r", "broken.md", 5, None, "modified")],
        "repo string, file_path string, size_bytes bigint, content string, status string")
    assert outcome(index_run.apply_changes(spark, path, changes, EMBED)) == {"o/r": (2, 1, 1)}
    chunks, ledger = index_store.load_index(spark, path)
    contents = {r.file_path: r.content for r in chunks.where("chunk_type = 'full_file'").collect()}
    assert contents == {
        "f0.md": "new text", "f1.md": "text 1", "f3.md": "text 3", "f4.md": "text 4", "f5.md": "text 5", "node_modules/y.js": "var a"}
    assert {r.file_path for r in ledger.collect()} == set(contents)


def test_removing_the_last_files_empties_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index_run.run_index(spark, path, files_df(spark, [("o/r", "a.md", "x"), ("o/s", "b.md", "y")]), EMBED)
    index_store.remove_files(spark, path, spark.createDataFrame([("o/r", "a.md")], "repo string, file_path string"))
    chunks, ledger = index_store.load_index(spark, path)
    assert [r.repo for r in chunks.collect()] == ["o/s"] and [r.repo for r in ledger.collect()] == ["o/s"]


def test_repair_after_lost_chunks(spark, tmp_path):
    import shutil
    path = str(tmp_path / "index")
    files = files_df(spark, [("o/r", "a.md", "x"), ("o/s", "b.md", "y")])
    index_run.run_index(spark, path, files, EMBED)
    segment = index_store.segments(spark, path)[0]["name"]
    left = index_store.load_index(spark, path)[0].where("repo = 'o/s'").toPandas()
    shutil.rmtree(tmp_path / "index" / segment / "chunks")
    spark.createDataFrame(left, schemas.CHUNKS).write.parquet(f"{path}/{segment}/chunks")
    assert outcome(index_run.run_index(spark, path, files, EMBED)) == {"o/r": (0, 1, 0), "o/s": (0, 1, 0)}
    assert outcome(index_run.run_index(spark, path, files, EMBED, repair=True)) == {"o/r": (1, 0, 0), "o/s": (0, 1, 0)}
    assert index_store.load_index(spark, path)[0].count() == 2


def test_missing_repository_names(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([(None, f"f{i}.md", 1, "text") for i in range(4)] + [(None, "f0.md", 1, "text")],
                                 "repo string, file_path string, size_bytes bigint, content string")
    assert outcome(index_run.run_index(spark, path, rows, EMBED)) == {"": (4, 0, 0)}
    assert outcome(index_run.run_index(spark, path, rows, EMBED)) == {"": (0, 4, 0)}
    chunks = spark.createDataFrame([(None, f"f{i}.md", 0, "t", "n", "c", [1.0]) for i in range(4)], schemas.CHUNKS)
    index_store.save_index(path, chunks, chunks.selectExpr("repo", "file_path", "'h' AS content_hash"))
    index_store.remove_files(spark, path, spark.createDataFrame([(None, "f1.md")], "repo string, file_path string"))
    assert index_store.load_index(spark, path)[0].count() == 3 and index_store.load_index(spark, path)[1].count() == 3


def test_failing_model_counts_as_errors(spark, tmp_path):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0] for _ in texts]

    files = files_df(spark, [("o/r", "a.md", "good"), ("o/r", "b.md", "bad")])
    run = index_run.run_index(spark, str(tmp_path / "index"), files, hooks.batch_embedder(model))
    assert {r.file_path for r in index_store.load_index(spark, str(tmp_path / "index"))[0].collect()} == {"a.md"}
    assert run.first().indexed == 1


def test_missing_index_is_empty(spark, tmp_path):
    chunks, ledger = index_store.load_index(spark, str(tmp_path / "none"))
    assert chunks.count() == 0 and ledger.count() == 0
    assert chunks.columns == schemas.CHUNKS.fieldNames()


def test_failed_embedding_keeps_the_old_state(spark, tmp_path):
    path = str(tmp_path / "index")
    index_run.run_index(spark, path, files_df(spark, [("o/r", "a.md", "old")]), EMBED)
    failing = hooks.batch_embedder(lambda texts: [[] for _ in texts])
    changed = files_df(spark, [("o/r", "a.md", "new")])
    assert outcome(index_run.run_index(spark, path, changed, failing)) == {"o/r": (0, 1, 0)}
    assert [r.content for r in index_store.load_index(spark, path)[0].collect()] == ["old"]
    assert outcome(index_run.run_index(spark, path, changed, EMBED)) == {"o/r": (1, 0, 0)}


def test_stored_text_is_cut_not_the_embedded_one(spark, tmp_path):
    path = str(tmp_path / "index")
    index_run.run_index(spark, path, files_df(spark, [("o/r", "a.md", "word " * 700)]), EMBED)
    row = index_store.load_index(spark, path)[0].first()
    assert len(row.content) == 500 and sum(row.embedding) == 700


def test_replace_keeps_other_files(spark):
    schema = "repo string, file_path string, chunk_index bigint"
    old = spark.createDataFrame([("r", "a", 0), ("r", "a", 1), ("r", "b", 0), ("s", "a", 0)], schema)
    new = spark.createDataFrame([("r", "a", 0)], schema)
    assert sorted(map(tuple, indexing.replace_chunks(old, new).collect())) == [("r", "a", 0), ("r", "b", 0), ("s", "a", 0)]

"""The index as a log: what an update writes, what a dead writer leaves, and what merging keeps."""

import hashlib
import random
import re

import pytest

from codetide import schemas
from codetide.sources import index_store

KEYS = "repo string, file_path string"


def chunks_of(spark, files, text="c"):
    return spark.createDataFrame([(repo, path, 0, "t", "n", f"{text} {path}", [1.0]) for repo, path in files], schemas.CHUNKS)


def noise(key):
    return "".join(hashlib.sha256(f"{key}{i}".encode()).hexdigest() for i in range(20))


def hashes(chunks, value="h"):
    return chunks.selectExpr("repo", "file_path", f"'{value}' AS content_hash")


def saved(spark, path, repos):
    rows = [(repo, f"f{i}.md", 0, "t", "n", noise(f"{repo} {i}"), [1.0]) for repo in repos for i in range(20)]
    chunks = spark.createDataFrame(rows, schemas.CHUNKS)
    index_store.save_index(path, chunks, hashes(chunks))
    return chunks.count()


def state(spark, path, **options):
    chunks, ledger = index_store.load_index(spark, path, **options)
    files = {(r.repo, r.file_path): r.content_hash for r in ledger.collect()}
    return files, {(r.repo, r.file_path): r.content for r in chunks.collect()}


def test_wanted_repositories_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    saved(spark, path, ("o/r", "o'\\s", "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    loaded = index_store.load_index(spark, path, repos=["o'\\s"])[0]
    assert loaded.count() == 20 and re.search(r"PushedFilters: \[[^\]]*EqualTo\(repo,o'", loaded._jdf.queryExecution().executedPlan().toString())


def test_updates_write_what_changes(spark, tmp_path):
    path = str(tmp_path / "index")
    total = saved(spark, path, [f"o/r{i}" for i in range(30)])

    def files():
        return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in (tmp_path / "index").rglob("*") if p.is_file()}

    before = files()
    index_store.remove_files(spark, path, spark.createDataFrame([("o/r3", "f3.md")], KEYS))
    every = spark.range(30).selectExpr("concat('o/r', id) AS repo", "'f7.md' AS file_path")
    index_store.remove_files(spark, path, every)
    assert [t.count() for t in index_store.load_index(spark, path)] == [total - 31] * 2
    new = chunks_of(spark, [("o/r5", "f1.md"), ("o/r5", "new.md")], "new")
    index_store.update_index(spark, path, new, hashes(new, "h2"))
    after = files()
    assert {p: after[p] for p in before} == before  # nothing that was there is touched
    sizes = [s["bytes"] for s in index_store.segments(spark, path)]
    assert all(size < sizes[0] / 2 for size in sizes[1:])
    ledger, texts = state(spark, path)
    assert len(ledger) == len(texts) == total - 30 and ledger["o/r5", "f1.md"] == "h2" and texts["o/r5", "f1.md"] == "new f1.md"


def test_dead_writers_leave_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    saved(spark, path, ["o/r"])
    before = state(spark, path)
    new = chunks_of(spark, [("o/r", "f1.md")], "new")

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:  # everything is written but the manifest
        patch.setattr(index_store, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            index_store.update_index(spark, path, new, hashes(new, "h2"))
    assert state(spark, path) == before and len(index_store.segments(spark, path)) == 1
    index_store.update_index(spark, path, new, hashes(new, "h2"))
    assert state(spark, path)[0]["o/r", "f1.md"] == "h2" and state(spark, path, version=1) == before
    with pytest.raises(index_store.Conflict):  # two writers from one version
        index_store._commit(spark, path, 1, [])
    index_store.vacuum(spark, path)
    assert len(list((tmp_path / "index" / "segments").iterdir())) == 2 and index_store.versions(spark, path) == [2]


def test_log_against_a_dictionary(spark, tmp_path):
    """Random updates, removals and merges, among them files that come back."""
    draw, path = random.Random(1), str(tmp_path / "index")
    files, texts, merged = {}, {}, 0
    for step in range(14):
        keys = draw.sample([(f"r{i}", f"f{j}") for i in range(3) for j in range(6)], draw.randrange(1, 5))
        if step % 4 == 3:
            index_store.remove_files(spark, path, spark.createDataFrame(keys, KEYS))
            for k in keys:
                files.pop(k, None), texts.pop(k, None)
        else:
            new = chunks_of(spark, keys, f"step {step}")
            index_store.update_index(spark, path, new, hashes(new, f"h{step}"))
            files |= {k: f"h{step}" for k in keys}
            texts |= {k: f"step {step} {k[1]}" for k in keys}
        merged += index_store.compact(spark, path)
        if step % 3 == 0 or step > 11:
            assert state(spark, path) == (files, texts)
    assert merged >= 2 and len(index_store.segments(spark, path)) <= 8
    nothing = spark.createDataFrame([], KEYS)
    known = index_store.versions(spark, path)
    index_store.remove_files(spark, path, nothing)
    assert index_store.versions(spark, path) == known

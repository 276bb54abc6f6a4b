"""Token postings on disk against a count of words in the sources."""

import collections
import re

from codetide import schemas
from codetide.operators import impact
from codetide.sources import index_store, postings


def files_df(spark, rows):
    return spark.createDataFrame([(r, p, len(c or ""), c) for r, p, c in rows], schemas.REPO_FILES)


def plain(rows):
    out = set()
    for repo, path, content in rows:
        if path.endswith(".py") and content:
            out |= {(repo or "", path, token, n) for token, n in collections.Counter(re.findall(r"[A-Za-z_]\w*", content)).items()}
    return out


def held(spark, path):
    return {(r.repo, r.file_path, r.symbol, r.mentions) for r in postings.load_postings(spark, path).collect()}


def test_update_replace_remove(spark, tmp_path):
    path = str(tmp_path / "postings")
    first = [("o/r", "a.py", "def f():\n    f()"), ("o/r", "b.py", "x = f"), (None, "c.py", "nobody"), ("o/r", "d.md", "f f f"), ("o/r", "e.py", ""), ("o/r", "g.py", None)]
    postings.update_postings(spark, path, files_df(spark, first))
    assert held(spark, path) == plain(first)
    second = [("o/r", "a.py", "g = 1"), ("o/r", "b.py", "x = f"), ("o/r", "n.py", "f f")]
    postings.update_postings(spark, path, files_df(spark, second + second[:1]))
    assert held(spark, path) == plain(second + [first[2]])
    newest = index_store.segments(spark, path)[-1]["name"]
    assert {r.file_path for r in spark.read.parquet(f"{path}/{newest}/files").collect()} == {"a.py", "n.py"}  # b.py was not written again
    postings.remove_postings(spark, path, spark.createDataFrame([("o/r", "a.py"), (None, "c.py")], "repo string, file_path string"))
    assert held(spark, path) == plain(second[1:])
    before = index_store.versions(spark, path)
    postings.update_postings(spark, path, files_df(spark, second[1:]))
    assert index_store.versions(spark, path) == before  # nothing changed, no version


def test_merging_keeps_the_postings(spark, tmp_path):
    path, rows = str(tmp_path / "postings"), {}
    for step in range(6):
        rows[f"f{step % 4}.py"] = f"alpha beta{step} alpha"
        postings.update_postings(spark, path, files_df(spark, [("o/r", p, c) for p, c in rows.items()]))
    assert held(spark, path) == plain([("o/r", p, c) for p, c in rows.items()])
    assert len(index_store.segments(spark, path)) < 6


def test_empty_store_and_asked_tokens(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "postings")
    assert held(spark, path) == set()
    postings.update_postings(spark, path, files_df(spark, []))
    assert index_store.versions(spark, path) == []
    files = files_df(spark, [("o/r", f"f{i:02}.py", "wanted " * (i % 9) + f"other{i}") for i in range(40)] + [("o/s", "z.py", "wanted")])
    postings.update_postings(spark, path, files)
    asked = spark.createDataFrame([("o/r", "wanted"), ("o/r", "other3"), ("o/r", "absent")], "repo string, name string")
    rows = lambda df: sorted(map(tuple, df.select("repo", "symbol", "file_path", "mentions", "hit_ord").collect()))
    want = rows(impact.mentioning_files(files, asked))
    assert len(want) == 6
    loaded = postings.load_postings(spark, path, asked)
    assert "In(symbol" in loaded._jdf.queryExecution().toString()  # the scan is filtered by token
    assert rows(impact.most_mentions(loaded, asked)) == want
    monkeypatch.setattr(postings, "PUSHED", 1)
    assert rows(impact.most_mentions(postings.load_postings(spark, path, asked), asked)) == want
    assert postings.load_postings(spark, path, asked.where("false")).count() == 0

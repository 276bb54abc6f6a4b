"""Summaries, report sections, readers of change requests and model hooks."""

import json
import re

from pyspark.sql import functions as F

from codetide import hooks, schemas
from codetide.operators import impact, review, risk
from codetide.plans import pr_review
from codetide.sources import readers, sinks

FILES = [
    ("o/r", 1, 0, "lib/shapes.py", "modified", '+def area(r):\n+    return r * r', 3, 2),
    ("o/r", 1, 1, "lib/draw.py", "modified", "+from lib.shapes import area", 15, 0),
    ("o/r", 1, 2, "logo.png", "added", None, None, None),
]


def files_df(spark, rows=FILES):
    return spark.createDataFrame(rows, schemas.PR_FILES)


def test_small_and_large_summaries(spark):
    structures = spark.createDataFrame([("o/r", "lib/draw.py", "Functions: draw")], "repo string, file_path string, structure string")
    rows = {r.file_ord: r for r in review.file_summaries(files_df(spark), structures).collect()}
    assert rows[0].summary == '**lib/shapes.py** (+3/-2)\n\nDiff content:\n```\n+def area(r):\n+    return r * r\n```'
    assert rows[1].summary.endswith("\n```\n\nContext: Functions: draw") and rows[1].size_class == "large"
    assert rows[2].summary == "**logo.png** (+0/-0)\n\nDiff content:\n```\n\n```"


def test_model_texts_replace_large_summaries_only(spark):
    requests = review.summary_requests(files_df(spark))
    assert [r.file_ord for r in requests.collect()] == [1]
    assert requests.first().request == (
        "File: lib/draw.py (+15/-0)\n\nCode Structure:\nN/A\n\nDiff:\n```\n+from lib.shapes import area\n```")
    written = hooks.batch_writer(lambda prompts: [f"- text of {len(p)}" for p in prompts])(requests)
    rows = {r.file_ord: r.summary for r in review.file_summaries(files_df(spark), written=written).collect()}
    assert rows[1].startswith("**lib/draw.py** (+15/-0)\n- text of ") and rows[0].startswith("**lib/shapes.py** (+3/-2)\n\nDiff")


def test_long_patches_are_cut_and_marked(spark):
    df = files_df(spark, [("o/r", 1, 0, "a.py", "m", "+" + "x" * 2000, 20, 0), ("o/r", 1, 1, "b.py", "m", "+" + "x" * 1999, 20, 0)])
    rows = {r.file_ord: r for r in review.summary_requests(df).collect()}
    assert "(+20/-0) (truncated)\n" in rows[0].request and "truncated" not in rows[1].request
    assert rows[0].request.count("x") == 1999


def test_report_of_one_change(spark):
    files = files_df(spark, FILES[:2])
    rows = review.report(risk.pr_risk(files), review.file_summaries(files), risk.issue_lists(files)).collect()
    assert len(rows) == 1
    assert rows[0].body == (
        "## PR Review (Fallback Mode)\n\n**Risk Level**: Low\n\n### Files Changed\n"
        "- lib/shapes.py (+3/-2)\n- lib/draw.py (+15/-0)\n"
        "\n⚠️ **Warning**: No tests were modified. Consider adding tests for the new code.")
    assert rows[0].issues_text == "✅ No security issues detected."
    assert rows[0].impact_text == "No cross-file impacts detected."
    assert rows[0].context_text == "No additional context found."
    assert rows[0].summaries_text.count("**") == 4


def test_report_of_a_large_change_comes_in_parts(spark):
    n = risk.FILES_PER_PART + 20
    files = files_df(spark, [("o/r", 1, i, f"f{i}.py", "m", "+eval(x)" if i == 110 else "+x", 1, 0) for i in range(n)])
    rows = review.report(risk.pr_risk(files), review.file_summaries(files), risk.issue_lists(files)).orderBy("part").collect()
    assert [r.part for r in rows] == [0, 1]
    listed = [line for r in rows for line in r.body.split("\n") if line.startswith("- ")]
    assert listed == [f"- f{i}.py (+1/-0)" for i in range(n)]
    assert rows[0].body.startswith("## PR Review (Fallback Mode)")
    assert "Warning" not in rows[0].body and rows[1].body.endswith("Consider adding tests for the new code.")
    assert rows[0].impact_text == "No cross-file impacts detected." and rows[1].impact_text == ""
    assert rows[0].issues_text == "" and rows[1].issues_text.endswith("Command Injection in `f110.py`")


def test_report_with_gaps_in_the_positions(spark):
    files = files_df(spark, [("o/r", 1, i, f"f{i}.py", "m", "+eval(x)" if i == 150 else "+x", 1, 0) for i in (3, 150, 1000)])
    rows = review.report(risk.pr_risk(files), review.file_summaries(files), risk.issue_lists(files)).orderBy("part").collect()
    assert [r.part for r in rows] == [0, 1, 10]
    listed = [line for r in rows for line in r.body.split("\n") if line.startswith("- ")]
    assert listed == [f"- f{i}.py (+1/-0)" for i in (3, 150, 1000)]
    assert rows[1].issues_text.endswith("Command Injection in `f150.py`") and rows[0].body.startswith("## PR Review")
    assert [r.body.endswith("for the new code.") for r in rows] == [False, False, True]


def test_model_review_and_fix(spark):
    files = files_df(spark, [("o/r", i, 0, "a.py", "m", "+eval(x)", 1, 0) for i in (1, 2)])
    texts = "repo string, pr_id bigint, text string"
    reviews = spark.createDataFrame([("o/r", 1, "Looks fine.")], texts)
    fixes = spark.createDataFrame([("o/r", 1, "Use ast."), ("o/r", 2, "No fixes needed.")], texts)
    rows = {r.pr_id: r.body for r in review.report(
        risk.pr_risk(files), review.file_summaries(files), risk.issue_lists(files), reviews=reviews, fixes=fixes).collect()}
    assert rows[1] == (
        "## 🔴 Risk Score: 75/100 (Critical)\n⚠️ **1 security issue(s) detected**\n\n---\n\nLooks fine."
        "\n\n---\n\n## 🔧 Suggested Fix\n\nUse ast.")
    assert "Fallback" in rows[2] and "Suggested Fix" not in rows[2]


def test_repeated_tokens_are_counted_in_place(spark):
    text = "alpha " * 100_000 + "alphabet beta beta _x $y 9z é1 é1"
    df = spark.createDataFrame([(text,)], "content string")
    got = {e.symbol: e.mentions for e in df.select(impact.token_counts("content").alias("t")).first().t}
    assert got == {"alpha": 100_000, "alphabet": 1, "beta": 2, "_x": 1, "$y": 1, "z": 1, "é1": 2}


def test_popular_symbol_search(spark):
    sources = [("o/r", f"u{i:04d}.py", "self " * (i % 7 + 1)) for i in range(500)]
    repo_files = spark.createDataFrame(sources, "repo string, file_path string, content string")
    wanted = spark.createDataFrame([("o/r", "self")], "repo string, name string")

    def found():
        return [(r.file_path, r.mentions) for r in impact.mentioning_files(repo_files, wanted).where("symbol = 'self'").orderBy("hit_ord").collect()]

    want = [(p, 7) for p in ("u0006.py", "u0013.py", "u0020.py", "u0027.py", "u0034.py")]
    assert found() == want
    assert impact.mentioning_files(repo_files, wanted.where("false")).count() == 0


def test_badge_colours(spark):
    df = spark.createDataFrame([(39, 0), (40, 0), (70, 2)], "score bigint, n bigint")
    got = [r[0] for r in df.orderBy("score").select(review.badge(F.col("score"), F.lit("X"), F.col("n"))).collect()]
    assert got == [
        "## 🟢 Risk Score: 39/100 (X)", "## 🟡 Risk Score: 40/100 (X)",
        "## 🔴 Risk Score: 70/100 (X)\n⚠️ **2 security issue(s) detected**"]


def test_section_texts(spark):
    impacted = spark.createDataFrame(
        [("o/r", 1, f"f{i}.py", "fn", i) for i in range(7)], "repo string, pr_id bigint, file string, symbol string, impact_ord bigint")
    text = review.impact_texts(impacted).first().impact_text
    assert text.split("\n") == [f"- `f{i}.py` may be affected by changes to `fn`" for i in range(5)]
    context = spark.createDataFrame(
        [("o/r", 1, 1, "a.py", "y" * 400, 0.876), ("o/r", 1, 2, "b.py", "b", 0.5)],
        "repo string, pr_id bigint, rank int, file string, content string, relevance double")
    assert review.context_texts(context).first().context_text == (
        "The following related code was found in the codebase:\n\n**`a.py`** (relevance: 0.88)\n```\n" + "y" * 300
        + "\n```\n\n**`b.py`** (relevance: 0.50)\n```\nb\n```")


def test_fix_candidates(spark):
    rows = [("o/r", 1, i, f"f{i}.py", "m", p, 1, 0) for i, p in enumerate(["+eval(x)" + "z" * 2000, None, "", "+eval(y)"])]
    rows += [("o/r", 2, 0, "a.py", "m", "+fine", 1, 0)]
    df = files_df(spark, rows)
    got = review.fix_candidates(df, risk.security_issues(df)).collect()
    assert [(r.pr_id, r.file_ord, len(r.patch)) for r in got] == [(1, 0, 1000)]
    assert got[0].snippet.startswith("### f0.py\n```diff\n+eval(x)")


def test_impact_search(spark):
    """Six Python files mention the symbol; the five best are taken before the change's own file drops out."""
    sources = [("o/r", "m.py", "def target():\n    pass\ntarget()\ntarget()\n")]
    sources += [("o/r", f"u{i}.py", "target()\n" * (i + 1)) for i in range(6)]
    sources += [("o/r", "u.js", "target() target() target() target()"), ("o/other", "x.py", "target()")]
    repo_files = spark.createDataFrame(sources, "repo string, file_path string, content string")
    changed = files_df(spark, [("o/r", 1, 0, "m.py", "m", "+", 1, 0), ("o/r", 1, 1, "gone.py", "m", "+", 1, 0)])
    wide = impact.symbol_table(impact.changed_sources(changed, repo_files))
    symbols = impact.pr_symbols(changed, wide)
    assert sorted((r.kind, r.name) for r in symbols.collect()) == [("function", "target")]
    found = impact.impact_analysis(changed, repo_files, symbols).orderBy("impact_ord").collect()
    assert [(r.file, r.reason) for r in found] == [(f"u{i}.py", "May use 'target'") for i in (5, 4, 3, 2)]


def test_first_symbols(spark):
    rows = [("o/r", 1, "function", n) for n in "edcba"] + [("o/r", 1, "class", n) for n in "ZYX"] + [("o/r", 1, "import", "os")]
    df = spark.createDataFrame(rows, "repo string, pr_id bigint, kind string, name string")
    got = sorted((r.symbol_ord, r.name) for r in impact.first_symbols(df, 3, 2).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "X"), (4, "Y")]


def test_query_text(spark):
    names = spark.createDataFrame(
        [("o/r", 1, "function", f"f{i}") for i in range(7)] + [("o/r", 1, "class", "C")], "repo string, pr_id bigint, kind string, name string")
    summaries = spark.createDataFrame(
        [("o/r", 1, i, f"s{i}" * 150) for i in range(4)] + [("o/r", 2, 0, "only")], "repo string, pr_id bigint, file_ord bigint, summary string")
    rows = {r.pr_id: r.query_text for r in pr_review.query_texts(None, names, summaries).collect()}
    assert rows[1].split("\n") == ["Functions: f0, f1, f2, f3, f4", "Classes: C"] + [(f"s{i}" * 150)[:200] for i in range(3)]
    assert rows[2] == "only"
    vectors = pr_review.embed_queries(pr_review.query_texts(None, names, summaries), hooks.hashing_embedder(dimensions=8)).collect()
    assert {r.pr_id: len(r.embedding) for r in vectors} == {1: 8, 2: 8}


def test_pr_documents(spark, tmp_path):
    path = tmp_path / "prs.json"
    good = {"installation_id": 1, "repo": "o/r", "pr_id": 4, "files": [
        {"filename": "a.py", "status": "modified", "patch": "+x", "additions": 1, "deletions": 0}, {"filename": "b.png", "status": "added"}]}
    path.write_text(json.dumps(good) + "\n" + json.dumps({"repo": "o/r", "pr_id": 5, "files": []}) + "\n")
    files, rejected = readers.read_pr_documents(spark, str(path))
    assert [(r.pr_id, r.file_ord, r.file_path, r.patch) for r in files.orderBy("file_ord").collect()] == [(4, 0, "a.py", "+x"), (4, 1, "b.png", None)]
    assert [(r.pr_id, r.error) for r in rejected.collect()] == [(5, "Missing context data")]


def test_repo_files_from_disk(spark, tmp_path):
    root = tmp_path / "mirror"
    (root / "own" / "name" / "src dir").mkdir(parents=True)
    (root / "own" / "name" / "src dir" / "a+b.py").write_text("x = 'é'\n", encoding="utf-8")
    (root / "own" / "name" / "bad.md").write_bytes(b"\xff\xfe\x00")
    rows = {r.file_path: r for r in readers.read_repo_files(spark, str(root)).collect()}
    assert set(rows) == {"src dir/a+b.py", "bad.md"}
    assert rows["src dir/a+b.py"].content == "x = 'é'\n" and rows["src dir/a+b.py"].size_bytes == 9
    assert rows["bad.md"].content is None and rows["bad.md"].repo == "own/name"


def test_review_sink(spark, tmp_path):
    reviews = spark.createDataFrame([("o/r", 1, 0, "body")], schemas.REVIEWS)
    sinks.write_reviews(reviews, str(tmp_path / "reviews"))
    sinks.write_reviews(reviews, str(tmp_path / "reviews"))
    assert spark.read.parquet(str(tmp_path / "reviews")).count() == 2


def test_one_body_or_pages_of_a_large_change(spark):
    """500 files with gaps in their positions: one ordered body, or pages that join to it."""
    files = spark.range(500).selectExpr("'o/r' AS repo", "1L AS pr_id", "id * 3 AS file_ord", "concat('f', id, '.py') AS file_path", "'+x' AS patch", "id AS additions", "0L AS deletions")
    files = files.union(spark.createDataFrame([("o/r", 2, 0, "only.py", "+y", 1, 1)], files.schema))
    report = review.report(risk.pr_risk(files), review.file_summaries(files), risk.issue_lists(files)).cache()
    whole = {r.pr_id: r.body for r in review.bodies(report).collect()}
    listed = re.findall(r"- (f[0-9]+)\.py \(\+([0-9]+)/-0\)\n", whole[1])
    assert listed == [(f"f{i}", str(i)) for i in range(500)] and whole[1].startswith("## PR Review") and whole[1].endswith("new code.")
    pages = sorted((r.pr_id, r.page, r.body) for r in review.bodies(report, 3000).collect())
    assert len(pages) > 3 and all("".join(b for i, _, b in pages if i == pr) == whole[pr] for pr in (1, 2))
    assert all(len(b) <= 3000 + report.selectExpr("max(length(body))").first()[0] for _, _, b in pages)

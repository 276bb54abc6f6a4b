"""Rule scan, risk score and gate on exact golden values."""

import re

import pytest
from pyspark.sql import functions as F

from codetide import schemas
from codetide.functions import paths, rules
from codetide.operators import risk

GOLDEN = [
    # path, patch, score, level, issue kinds
    (".env", "+SECRET=abc123", 30, "Medium", ["sensitive_file"]),
    ("deploy/db.py", '+db_password = "tr0ub4dor-77"', 35, "Medium", ["hardcoded_secret"]),
    ("store.py", "+conn.execute(stmt + where)", 50, "High", ["sql_injection"]),
    ("price.py", '+price = eval("1.2 * " + factor)', 50, "High", ["command_injection"]),
    ("requirements.txt", "+pycrypto>=2,<3", 25, "Low", ["vulnerable_package"]),
    ("layout.py", "+limit = min(width, 80)", 0, "Low", []),
    ("a.py", "+OPENAI_KEY = abcdefghijklmnopqrstuvwx", 0, "Low", []),
    ("a.py", '+requests.get(f"{u}")', 0, "Low", []),
    ("a.py", '-price = eval("1.2 * " + factor)\n price = eval(factor)', 0, "Low", []),
    ("a.py", None, 0, "Low", []),
    # A negated class crosses lines: the next added "+" closes the match.
    ("a.py", "+cursor.execute(q)\n+next()", 50, "High", ["sql_injection"]),
    ("a.py", "+nodes(", 20, "Low", ["insecure_crypto"]),
    ("a.py", '+execute("select %s", (x,))', 50, "High", ["sql_injection"]),
    ("sub/requirements.txt", "+pycrypto", 0, "Low", []),
    ("Pipfile", "-PyYAML and Python-JWT", 50, "High", ["vulnerable_package", "vulnerable_package"]),
    ("package.json", ' "ua-parser-js": 1', 25, "Low", ["vulnerable_package"]),
    ("go.mod", "+pycrypto", 0, "Low", []),
    # Unicode case folding: long s in "password", Kelvin sign in "api_key".
    ("a.py", '+db_paſsword = "tr0ub4dor-77"', 35, "Medium", ["hardcoded_secret"]),
    ("a.py", '+api_Key = "abcdefghij0123456789"', 35, "Medium", ["hardcoded_secret"]),
    # ASCII separators count as white space.
    ("a.py", "+eval\x1c(x", 50, "High", ["command_injection"]),
    # Only a line feed ends a line.
    ("a.py", "+execute(a,\r %s", 50, "High", ["sql_injection"]),
    ("a.py", "+execute(a,\n+ %s", 0, "Low", []),
    ("a.py", "+eval(user) md5(x) pickle.load(f)", 90, "Critical", ["command_injection", "insecure_crypto", "insecure_deserialization"]),
    ("id_rsa", "+execute(a + b) open(c + d) eval(e)", 100, "Critical",
     ["sensitive_file", "command_injection", "sql_injection", "path_traversal"]),
]

# One line per pattern that the pattern's category must report.
POSITIVE = [
    ("command_injection", '+eval("a" + b)'), ("command_injection", "+eval(user_input)"), ("command_injection", '+exec("a" + b)'),
    ("command_injection", '+os.system("rm " + p)'), ("command_injection", "+subprocess.call(cmd shell=True)"),
    ("sql_injection", "+execute(sql + x)"), ("sql_injection", '+execute("select %s", (x,))'), ("sql_injection", "+cursor.execute(q + x)"),
    ("sql_injection", '+q = f"SELECT {c}"'), ("sql_injection", '+q = f"INSERT {c}"'), ("sql_injection", "+q = f'UPDATE {c}'"),
    ("sql_injection", "+q = f'DELETE {c}'"), ("path_traversal", '+open("a" + b)'), ("path_traversal", '+open(f"{p}")'),
    ("path_traversal", '+os.path.join("a" + b)'), ("path_traversal", '+file_path = f"{p}"'), ("path_traversal", '+with open(f"{p}")'),
    ("xss_risk", "+el.innerHTML = a + b"), ("xss_risk", "+el.innerHTML = `${x}`"), ("xss_risk", "+dangerouslySetInnerHTML"),
    ("xss_risk", '+document.write("a" + b)'), ("hardcoded_secret", '+db_password = "tr0ub4dor-77"'),
    ("hardcoded_secret", '+api_key = "abcdefghij0123456789"'), ("hardcoded_secret", '+secret_key = "x"'),
    ("hardcoded_secret", "+AWS_SECRET_ACCESS_KEY = x"), ("hardcoded_secret", "+PRIVATE_KEY = x"), ("open_redirect", '+redirect("a" + b)'),
    ("open_redirect", "+redirect(request.args)"), ("open_redirect", '+HttpResponseRedirect("a" + b)'), ("open_redirect", '+res.redirect("a" + b)'),
    ("template_injection", "+render_template_string(t)"), ("template_injection", '+Template("a" + b)'), ("template_injection", '+t.render("a" + b)'),
    ("insecure_crypto", "+md5(x)"), ("insecure_crypto", "+sha1(x)"), ("insecure_crypto", "+DES(k)"), ("insecure_crypto", "+random.random()"),
    ("insecure_deserialization", "+pickle.loads(b)"), ("insecure_deserialization", "+yaml.load(f)"), ("nosql_injection", "+{$where: 1}"),
    ("nosql_injection", '+db.find({"a": {$gt: 1})'), ("weak_jwt", '+jwt(algorithm="none")'), ("weak_jwt", "+decode(t, verify=False)"),
]
EXTENDED = [
    ("hardcoded_secret", "+OPENAI_KEY = abcdefghijklmnopqrstuvwx"), ("hardcoded_secret", "+APP_SECRET = abcdefghij"),
    ("hardcoded_secret", "+X_TOKEN = abcdefghijklmnopqrst"), ("hardcoded_secret", "+SLACK_TOKEN = x"), ("ssrf", '+requests.get("a" + b)'),
    ("ssrf", '+requests.post(f"{u}")'), ("ssrf", '+urllib.request.urlopen("a" + b)'), ("ssrf", '+httpx.get(f"{u}")'),
]


def files_df(spark, rows):
    return spark.createDataFrame(rows, schemas.PR_FILES)


def lone(spark, pairs):
    """One change per (path, patch); a test file keeps the missing-tests points out."""
    return files_df(spark, [
        row for i, (path, patch) in enumerate(pairs)
        for row in (("o/r", i, 0, path, "modified", patch, 1, 0), ("o/r", i, 1, "test_x.py", "modified", None, 0, 0))
    ])


@pytest.fixture(scope="module")
def golden(spark):
    df = lone(spark, [(g[0], g[1]) for g in GOLDEN])
    scores = {r.pr_id: r for r in risk.pr_risk(df).collect()}
    issues = {}
    for r in risk.security_issues(df).orderBy("pr_id", "file_ord", "issue_ord").collect():
        issues.setdefault(r.pr_id, []).append(r.kind)
    return scores, issues


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(golden, i):
    scores, issues = golden
    _, _, score, level, kinds = GOLDEN[i]
    assert (scores[i].score, scores[i].level, issues.get(i, [])) == (score, level, kinds)
    assert scores[i].issue_count == len(kinds)


def test_every_pattern_reports_its_category(spark):
    df = lone(spark, [("a.py", line) for _, line in POSITIVE])
    found = {(r.pr_id, r.kind) for r in risk.pattern_findings(df).collect()}
    assert all((i, category) in found for i, (category, _) in enumerate(POSITIVE))


def test_extended_pack(spark):
    df = lone(spark, [("a.py", line) for _, line in EXTENDED])
    plain = {(r.pr_id, r.kind) for r in risk.pattern_findings(df).collect()}
    found = {(r.pr_id, r.kind) for r in risk.pattern_findings(df, "extended").collect()}
    assert not any((i, category) in plain for i, (category, _) in enumerate(EXTENDED))
    assert all((i, category) in found for i, (category, _) in enumerate(EXTENDED))


def test_scan_agrees_with_python_re(spark):
    """Every default pattern against every line and its variants, on Python's own engine."""
    lines = [line for _, line in POSITIVE + EXTENDED]
    texts = lines + [line.swapcase() for line in lines] + [line.replace("(", "\n+(").replace(" ", " ") for line in lines]
    df = lone(spark, [("a.py", t) for t in texts])
    found = {(r.pr_id, r.kind) for r in risk.pattern_findings(df).collect()}
    want = set()
    for i, patch in enumerate(texts):
        added = "\n".join(x for x in patch.split("\n") if x.startswith("+"))
        for category, _, _, patterns in rules.DEFAULT_RULES:
            if any(re.search(p, added, re.IGNORECASE) for p, _ in patterns):
                want.add((i, category))
    assert found == want


def test_random_code_agrees_with_python_re(spark):
    """Random mixes of fragments, odd white space and case-folding letters."""
    import random
    rng = random.Random(11)
    pieces = [
        "eval", "EXEC", "execute", "cursor.", "open", "wıth", "with", "os.system", "os.path.join", "subprocess.call", "innerHTML", "document.write",
        "paſsword", "PASSWORD", "api_key", "API-Key", "secret", "aws", "private", "key", "redirect", "request.", ".render", "Template", "md5", "ſha1",
        "DES", "random.random", "pickle.load", "s", "yaml.load", "$where", ".fınd", ".find", "algorithm", "verify", "False", "shell", "True", "f",
        "SELECT", "(", ")", "()", "+", "=", ":", "{", "}", "[", ",", "%s", "$", "'", '"', " ", "\t", "\n+", "\n", "\x0b", "\x1c", "\x85", "\u2028",
        "\u00a0", "\r", "x", "İ", "tr0ub4dor-77", "abcdefghij0123456789", "none", "İs", "é", "_", "-"]
    pieces += ["(", "+", "=", '"', "{", "x"] * 8
    texts = ["+" + "".join(rng.choice(pieces) for _ in range(rng.randint(5, 60))) for _ in range(4000)]
    df = lone(spark, [("a.py", t) for t in texts]).repartition(8)
    found = {(r.pr_id, r.kind) for r in risk.pattern_findings(df).collect()}
    want = set()
    for i, patch in enumerate(texts):
        added = "\n".join(x for x in patch.split("\n") if x.startswith("+"))
        want |= {(i, c) for c, _, _, patterns in rules.DEFAULT_RULES if any(re.search(p, added, re.IGNORECASE) for p, _ in patterns)}
    assert len(want) > 200
    assert {(texts[i], c) for i, c in found ^ want} == set()


def test_size_factors(spark):
    metrics = spark.createDataFrame(
        [("o/r", 1, 8, 350, 50, True, 3, 0), ("o/r", 2, 11, 501, 0, False, 6, 0), ("o/r", 3, 5, 200, 0, None, 0, 0)],
        "repo string, pr_id bigint, changed_files_count bigint, total_additions bigint, total_deletions bigint,"
        "missing_tests boolean, impacted_files bigint, security_points bigint")
    rows = {r.pr_id: r for r in risk.score_risk(metrics).collect()}
    assert (rows[1].score, rows[1].level) == (50, "High")
    assert rows[1].reasons == [
        "Medium-sized PR (8 files)", "Many lines changed (400)".replace("Many", "Moderate"), "No tests modified",
        "Some impact (3 files may be affected)"]
    assert (rows[2].score, rows[2].reasons) == (
        60, ["Large PR (11 files)", "Many lines changed (501)", "High impact (6 files may be affected)"])
    assert (rows[3].score, rows[3].level, rows[3].reasons) == (0, "Low", [])


def test_gate_thresholds(spark):
    scored = spark.createDataFrame([(69,), (70,)], "score bigint")
    rows = [(r.state, r.description) for r in risk.gate(scored).orderBy("score").collect()]
    assert rows == [
        ("success", "AI review passed (risk: 69/100)"),
        ("failure", "High risk PR (score: 70/100). Please address concerns.")]


def test_impact_counts_enter_the_score(spark):
    df = lone(spark, [("a.py", "+x")])
    impact = spark.createDataFrame([("o/r", 0, f"f{i}") for i in range(6)], "repo string, pr_id bigint, file string")
    row = risk.pr_risk(df, impact).first()
    assert (row.score, row.reasons) == (15, ["High impact (6 files may be affected)"])


def test_test_impact(spark):
    df = files_df(spark, [
        ("o/r", 1, 0, "a.py", None, None, 1, 1), ("o/r", 1, 1, "Tests/a.py", None, None, None, None),
        ("o/r", 2, 0, "a.py", None, None, 1, 1), ("o/r", 3, 0, "latest.md", None, None, 1, 1)])
    rows = {r.pr_id: (r.tests_modified, r.missing_tests) for r in risk.test_impact(df).collect()}
    assert rows == {1: (True, False), 2: (False, True), 3: (True, False)}
    assert {(r.pr_id, r.total_additions, r.changed_files_count) for r in risk.pr_totals(df).collect()} == {(1, 1, 2), (2, 1, 1), (3, 1, 1)}


def test_large_change_is_listed_in_bounded_parts(spark):
    n = 2 * risk.FILES_PER_PART + 7
    df = files_df(spark, [("o/r", 1, i, f"f{i}.py", "modified", "+md5(x)", 1, 0) for i in range(n)])
    lists = risk.issue_lists(df).orderBy("part").collect()
    assert [len(r.security_issues) for r in lists] == [risk.FILES_PER_PART, risk.FILES_PER_PART, 7]
    texts = [t for r in lists for t in r.security_issues]
    assert texts == [f"🟡 [Medium] Insecure Cryptography in `f{i}.py`" for i in range(n)]
    assert risk.pr_risk(df).first().issue_count == n


@pytest.mark.parametrize("path, expected", [
    (".env", True), ("a/.env.local", True), ("a/.env.test", False), ("keys/server.pem", True), ("x.PEM", False), ("a/id_rsa", True),
    ("Config/Secrets/x.py", True), ("home/.aws/c", True), ("private-key.txt", True), ("privatekey", True), ("src/a.py", False),
    ("secrets.yaml", True), ("mysecrets.yaml", False)])
def test_sensitive_paths(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.is_sensitive(F.col("p"))).first()[0] is expected


@pytest.mark.parametrize("path, language, indexed, skipped", [
    ("a.py", "python", True, False), ("a/B.JSX", "javascript", True, False), ("x.mjs", "javascript", True, False),
    ("a.b/Makefile", None, False, False), ("Makefile", None, False, False), ("x.hpp", "cpp", True, False), ("x.h", "c", True, False),
    ("doc.md", None, True, False), ("node_modules/a.js", "javascript", True, True), ("a/node_modules", None, False, False),
    ("a/Build/x.go", "go", True, False), ("a/build/x.go", "go", True, True), ("my.venv/x.py", "python", True, False),
    (".venv/x.py", "python", True, True), ("xvenv/x.py", "python", True, False)])
def test_path_lookups(spark, path, language, indexed, skipped):
    df = spark.createDataFrame([(path,)], "p string")
    p = F.col("p")
    assert tuple(df.select(paths.language(p), paths.is_indexed_type(p), paths.in_skipped_directory(p)).first()) == (language, indexed, skipped)


def test_host_totals_count_before_sums(spark):
    """A host may list more than it delivers; where it says nothing the files are added up."""
    from codetide.sources import readers

    documents = spark.createDataFrame(
        [(1, "o/r", 1, "c1", 12, 400, 200, [("a.py", "modified", "+x", 1, 1), ("b.py", "added", None, 2, None)]),
         (1, "o/r", 2, "c2", None, None, None, [("a.py", "modified", "+x", 3, 4)]), (None, "o/r", 3, "c3", 1, 1, 1, [])], schemas.PR_DOCUMENT)
    files, rejected = readers.explode_pr_documents(documents)
    got = {r.pr_id: r for r in risk.pr_risk(files).collect()}
    assert (got[1].changed_files_count, got[1].total_additions, got[1].total_deletions) == (12, 400, 200)
    assert got[1].reasons[:2] == ["Large PR (12 files)", "Many lines changed (600)"]
    assert (got[2].changed_files_count, got[2].total_additions, got[2].total_deletions) == (1, 3, 4)
    assert {r.pr_id: tuple(r)[2:] for r in risk.pr_totals(files).collect()} == {1: (400, 200, 12), 2: (3, 4, 1)}
    assert [r.pr_id for r in rejected.collect()] == [3]


def test_rule_table_of_any_size(spark):
    """500 rules in 200 categories against Python's patterns: without, with and with too many fragments."""
    import re

    table = [(i, f"c{i % 200}", i // 200, i % 200, f"rule {i % 200}", rf"mark{i}\s*\(", f"mark{i}") for i in range(500)]
    table += [(500, "free", 0, 5, "free", r"[0-9]{9}", None), (501, "fold", 0, 7, "fold", "kiss", "kiss")]
    texts = [f"+mark{i} (x)\n+MARK{i + 3}(\n mark7(" for i in range(0, 520, 5)] + ["+123456789", "+Kiſs", "+nothing", "", None, "+mark9\x1c("]
    files = spark.createDataFrame([("o/r", 1, i, f"f{i}", t, 0, 0) for i, t in enumerate(texts)], "repo string, pr_id long, file_ord long, file_path string, patch string, additions long, deletions long")
    want = {}
    for i, t in enumerate(texts):
        added = "\n".join(line for line in (t or "").split("\n") if line.startswith("+"))
        for _, category, at, points, label, pattern, _ in table:
            if re.search(pattern.replace(r"\s", r"[\s\x1c-\x1f]"), added, re.I):
                want.setdefault((i, category, points, label), []).append(at)
    frame = spark.createDataFrame(table, risk.RULE_TABLE)
    for fragments in (5000, 40, 1):
        found = risk.rule_findings(files, frame, fragments)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.file_ord, r.category, r.points, r.label): r.positions for r in found.collect()} == want
    assert risk.rule_findings(files, frame.where("false")).count() == 0


def test_rule_table_agrees_with_the_packs(spark):
    files = spark.createDataFrame(
        [("o/r", 1, 0, "a.py", "+x = eval(a + b)\n+password = 'longenough1'"), ("o/r", 1, 1, "b.js", "+el.innerHTML = a + b\n-md5(x)"), ("o/r", 2, 0, "c.py", "+API_KEY = abcdefghijklmnopqrstuvwx")],
        "repo string, pr_id long, file_ord long, file_path string, patch string").selectExpr("*", "0L AS additions", "0L AS deletions")
    for pack in ("default", "extended"):
        table = {(r.pr_id, r.file_ord, r.category, r.points) for r in risk.rule_findings(files, risk.rule_table(spark, pack)).collect()}
        assert table == {(r.pr_id, r.file_ord, r.kind, r.points) for r in risk.pattern_findings(files, pack).collect()}

"""Security scan and risk score of change requests.

The scan is one narrow projection per file. Scores need a single shuffle of one short
partial row per (task, change), so a change holding any share of the files stays cheap.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from codetide.functions import paths, rules, text

PR = ["repo", "pr_id"]
# Lists per change are delivered in parts of this many positions, so no row grows with the change.
FILES_PER_PART = 100

# Case-insensitive and Unicode-aware, only "\n" ends a line; \s includes the ASCII separators.
_REGEX_FLAGS = "(?iUd)"
_SPACE = r"[\s\x1c-\x1f]"


def _pattern_hit(pattern: str, needle: str) -> Column:
    """Regex search guarded by a plain substring test, exact for any text.

    Texts with a letter that folds to an ASCII one (long s, Kelvin, dotted and dotless i) could hide
    the substring from the test, so they always run the regex.
    """
    possible = F.col("_folds") | F.contains(F.col("_lower"), F.lit(needle))
    return possible & F.col("added_code").rlike(_REGEX_FLAGS + pattern.replace(r"\s", _SPACE))


def _package_hits() -> list[tuple[str, Column]]:
    path, patch = F.col("file_path"), F.lower(F.col("patch"))
    python, script = path.isin("requirements.txt", "Pipfile"), path == "package.json"
    return [
        (name, manifest & F.contains(patch, F.lit(name)))
        for manifest, names in ((python, rules.VULNERABLE_PYTHON), (script, rules.VULNERABLE_JAVASCRIPT))
        for name in names
    ]


def _checks(pack) -> list[tuple[str, int, Column]]:
    """(kind, points, issue text) in reporting order within a file; the position is the bit in `hits`.

    `pack` names a rule pack or is one, in the form of rules.DEFAULT_RULES.
    """
    ticked = F.concat(F.lit("`"), F.col("file_path"), F.lit("`"))
    checks = [("sensitive_file", rules.SENSITIVE_POINTS, F.concat(F.lit("🔴 Sensitive file modified: "), ticked))]
    for category, points, label, _ in rules.rule_pack(pack):
        checks.append((category, points, F.concat(F.lit(f"{label} in "), ticked)))
    for name in (*rules.VULNERABLE_PYTHON, *rules.VULNERABLE_JAVASCRIPT):
        checks.append(("vulnerable_package", rules.PACKAGE_POINTS, F.lit(f"📦 Potentially vulnerable package: `{name}`")))
    if len(checks) > 62:
        raise ValueError("a rule pack holds at most 55 categories")
    return checks


def scan_files(pr_files: DataFrame, pack="default") -> DataFrame:
    """The scan: one narrow pass over the patches that leaves a bit mask `hits` per file."""
    path = F.col("file_path")
    conditions = [paths.is_sensitive(path)]
    for _, _, _, patterns in rules.rule_pack(pack):
        conditions.append(reduce(lambda a, b: a | b, (_pattern_hit(p, needle) for p, needle in patterns)))
    conditions += [hit for _, hit in _package_hits()]
    bits = reduce(add, (F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, hit in enumerate(conditions)))
    return (
        pr_files.withColumn("added_code", text.added_code(F.col("patch")))
        .withColumns({"_lower": F.lower("added_code"), "_folds": F.col("added_code").rlike("[\u017f\u212a\u0130\u0131]")})
        .select(*PR, "file_ord", "file_path", "additions", "deletions", *_host_columns(pr_files), bits.alias("hits"))
    )


def _scanned(files: DataFrame, pack) -> DataFrame:
    return files if "hits" in files.columns else scan_files(files, pack)


def _bit(i: int) -> Column:
    return F.col("hits").bitwiseAND(F.lit(1 << i)) != 0


def security_issues(files: DataFrame, pack="default") -> DataFrame:
    """One row per issue of changed files (scanned or not), ordered by (file_ord, issue_ord) inside a change."""
    candidates = F.array(*[
        F.when(_bit(i), F.struct(
            F.lit(i).alias("issue_ord"), F.lit(kind).alias("kind"), F.lit(points).alias("points"), txt.alias("text")))
        for i, (kind, points, txt) in enumerate(_checks(pack))
    ])
    return (
        _scanned(files, pack).select(*PR, "file_ord", "file_path", F.explode(candidates).alias("issue"))
        .where(F.col("issue").isNotNull())
        .select(*PR, "file_ord", "file_path", "issue.issue_ord", "issue.kind", "issue.points", "issue.text")
    )


def pattern_findings(files: DataFrame, pack="default") -> DataFrame:
    """Rule findings only: at most one row per (file, category)."""
    return security_issues(files, pack).where(~F.col("kind").isin("sensitive_file", "vulnerable_package"))


def _host_columns(files: DataFrame) -> list[str]:
    return [c for c in ("host_files", "host_additions", "host_deletions") if c in files.columns]


def _totals(files: DataFrame) -> list[Column]:
    """Counts of a change: those that the host states where it does, else sums over its files."""
    known = _host_columns(files)
    sums = (("host_additions", F.sum(F.coalesce("additions", F.lit(0))), "total_additions"),
            ("host_deletions", F.sum(F.coalesce("deletions", F.lit(0))), "total_deletions"),
            ("host_files", F.count(F.lit(1)), "changed_files_count"))
    return [(F.coalesce(F.max(host), total) if host in known else total).alias(name) for host, total, name in sums]


def rule_table(spark, pack="default") -> DataFrame:
    """A rule pack as a table: one row per pattern, in reporting order."""
    rows = [(category, at, points, label, pattern, needle) for category, points, label, patterns in rules.rule_pack(pack) for at, (pattern, needle) in enumerate(patterns)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], RULE_TABLE)


RULE_TABLE = "rule long, category string, position long, points long, label string, pattern string, fragment string"
# Fragments that every text is searched for; of more, ever shorter heads are searched for.
FRAGMENTS = 5000


def _heads(rule_rows: DataFrame, most: int) -> tuple[int, list[str]]:
    """Length and values of the fragment heads to search for: whole fragments if there are at most `most`."""
    for length in (1 << 20, 8, 6, 4, 3, 2, 1, 0):
        head = F.substring(F.lower(F.coalesce("fragment", F.lit(""))), 1, length) if length else F.lit("")
        found = [r[0] for r in rule_rows.select(head).distinct().limit(most + 1).collect()]
        if len(found) <= most:
            break
    return length, found


def rule_findings(pr_files: DataFrame, rule_rows: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per file and category of a table of rules (RULE_TABLE), with the positions of the patterns that match.

    `fragment` is a text that every match of the pattern contains, in lower case; null where there is none.
    A file is searched for all fragments first; patterns run on the pairs that an equi-join on the fragment
    gives, so any number of rules and categories will do. No letter outside ASCII may stand in a fragment.
    """
    length, heads = _heads(rule_rows, fragments)
    head = F.substring(F.lower(F.coalesce("fragment", F.lit(""))), 1, length) if length else F.lit("")
    pattern = F.concat(F.lit(_REGEX_FLAGS), F.replace("pattern", F.lit(r"\s"), F.lit(_SPACE)))
    ruled = rule_rows.select(head.alias("_head"), "category", "position", "points", "label", pattern.alias("_pattern"))
    # Letters that fold to ASCII ones are replaced by these, so that no fragment is missed.
    plain = F.lower(F.translate("added_code", "\u017f\u212a\u0130\u0131", "skii"))
    wanted = F.array(*map(F.lit, heads)) if heads else F.array().cast("array<string>")
    files = pr_files.select(*PR, "file_ord", "file_path", text.added_code(F.col("patch")).alias("added_code"))
    present = F.transform(F.array(plain), lambda t: F.filter(wanted, lambda h: F.contains(t, h)))[0]
    pairs = files.select("*", F.explode(present).alias("_head")).join(ruled, "_head").where(F.rlike("added_code", F.col("_pattern")))
    return (
        pairs.groupBy(*PR, "file_ord", "file_path", "category")
        .agg(F.max("points").alias("points"), F.min("label").alias("label"), F.sort_array(F.collect_set("position")).alias("positions"))
    )


def pr_totals(pr_files: DataFrame) -> DataFrame:
    return pr_files.groupBy(*PR).agg(*_totals(pr_files))


def test_impact(pr_files: DataFrame) -> DataFrame:
    is_test = paths.is_test(F.col("file_path"))
    return (
        pr_files.groupBy(*PR)
        .agg(F.bool_or(is_test).alias("tests_modified"), F.bool_or(~is_test).alias("_code"))
        .select(*PR, "tests_modified", (F.col("_code") & ~F.col("tests_modified")).alias("missing_tests"))
    )


def pr_metrics(files: DataFrame, pack="default") -> DataFrame:
    """All per-change counts of changed files (scanned or not) in one aggregation."""
    is_test = paths.is_test(F.col("file_path"))
    points = reduce(add, (F.when(_bit(i), F.lit(pts)).otherwise(F.lit(0)) for i, (_, pts, _) in enumerate(_checks(pack))))
    per_file = _scanned(files, pack).select(
        *PR, "additions", "deletions", *_host_columns(files), is_test.alias("_test"), points.alias("_points"), F.bit_count("hits").alias("_issues"),
    )
    return (
        per_file.groupBy(*PR)
        .agg(
            *_totals(files),
            F.bool_or("_test").alias("tests_modified"),
            F.bool_or(~F.col("_test")).alias("_code"),
            F.sum("_points").alias("security_points"),
            F.sum("_issues").alias("issue_count"),
        )
        .withColumn("missing_tests", F.col("_code") & ~F.col("tests_modified"))
        .drop("_code")
    )


def _step(value: Column, steps, result) -> Column:
    out = None
    for bound, points, reason in steps:
        out = F.when(value > bound, result(points, reason)) if out is None else out.when(
            value > bound, result(points, reason))
    return out


def score_risk(metrics: DataFrame) -> DataFrame:
    """Add score, level and reasons to per-change counts.

    Needs changed_files_count, total_additions, total_deletions, missing_tests, impacted_files,
    security_points. The level is taken before the score is capped.
    """
    lines = F.coalesce("total_additions", F.lit(0)) + F.coalesce("total_deletions", F.lit(0))
    steps = (
        (F.col("changed_files_count"), rules.FILES_STEPS),
        (lines, rules.LINES_STEPS),
        (F.col("impacted_files"), rules.IMPACT_STEPS),
    )
    sized = [F.coalesce(_step(value, table, lambda pts, _: F.lit(pts)), F.lit(0)) for value, table in steps]
    untested = F.coalesce("missing_tests", F.lit(False))
    raw = (
        reduce(add, sized)
        + F.when(untested, F.lit(rules.MISSING_TESTS_POINTS)).otherwise(F.lit(0))
        + F.coalesce("security_points", F.lit(0))
    ).cast("bigint")

    def phrase(value: Column):
        return lambda _, reason: F.concat(
            F.lit(reason.split("{}")[0]), value.cast("string"), F.lit(reason.split("{}")[1]))

    files_reason, lines_reason, impact_reason = (_step(value, table, phrase(value)) for value, table in steps)
    reasons = F.array_compact(F.array(
        files_reason, lines_reason, F.when(untested, F.lit("No tests modified")), impact_reason))
    level = F.lit("Low")
    for bound, name in reversed(rules.LEVELS):
        level = F.when(F.col("_raw") >= bound, F.lit(name)).otherwise(level)
    return (
        metrics.withColumn("_raw", raw)
        .withColumn("score", F.least("_raw", F.lit(rules.MAX_SCORE).cast("bigint")))
        .withColumn("level", level)
        .withColumn("reasons", reasons)
        .drop("_raw")
    )


def pr_risk(files: DataFrame, impact: DataFrame | None = None, pack="default") -> DataFrame:
    """Risk of each change from its files, scanned or not. `impact` holds one row per impacted file (repo, pr_id, file, ...)."""
    metrics = pr_metrics(files, pack)
    if impact is None:
        counted = metrics.withColumn("impacted_files", F.lit(0).cast("bigint"))
    else:
        sizes = impact.groupBy(*PR).agg(F.count(F.lit(1)).alias("impacted_files"))
        counted = metrics.join(sizes, PR, "left").fillna(0, ["impacted_files"])
    return score_risk(counted)


def gate(risk: DataFrame) -> DataFrame:
    """Pass/fail state of each scored change."""
    score = F.col("score").cast("string")
    blocked = F.col("score") >= rules.BLOCK_THRESHOLD
    return risk.withColumn("state", F.when(blocked, "failure").otherwise("success")).withColumn(
        "description",
        F.when(blocked, F.concat(F.lit("High risk PR (score: "), score, F.lit("/100). Please address concerns.")))
        .otherwise(F.concat(F.lit("AI review passed (risk: "), score, F.lit("/100)"))),
    )


def part_of(file_ord: Column) -> Column:
    return F.floor(file_ord / FILES_PER_PART).cast("bigint")


def issue_lists(files: DataFrame, pack="default") -> DataFrame:
    """Ordered issue texts per change, in parts of at most FILES_PER_PART files."""
    return (
        security_issues(files, pack)
        .groupBy(*PR, part_of(F.col("file_ord")).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("file_ord", "issue_ord", "text"))).alias("_issues"))
        .select(*PR, "part", F.transform("_issues", lambda i: i["text"]).alias("security_issues"))
    )


def risk_factors(risk: DataFrame, issues: DataFrame) -> DataFrame:
    """Every contribution to a score as rows: change-level reasons first, then issues by file."""
    reasons = risk.select(*PR, F.posexplode("reasons").alias("ord", "text")).select(
        *PR, F.lit(-1).cast("bigint").alias("file_ord"), F.lit(None).cast("string").alias("file_path"),
        "ord", F.lit("reason").alias("factor"), "text",
    )
    rows = issues.select(*PR, "file_ord", "file_path", F.col("issue_ord").alias("ord"), F.col("kind").alias("factor"), "text")
    return reasons.unionByName(rows)

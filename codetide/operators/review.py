"""File summaries, report sections and review bodies.

Everything that concatenates files works on parts of FILES_PER_PART files, keyed
(repo, pr_id, part); a change of ordinary size has the single part 0.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codetide.functions import rules
from codetide.operators.risk import FILES_PER_PART, PR, part_of

# Text limits.
PATCH_CHARS, FIX_PATCH_CHARS, CONTEXT_CHARS, QUERY_SUMMARY_CHARS = 2000, 1000, 300, 200
SMALL_CHANGE_LINES, FIX_FILES, QUERY_FILES, QUERY_SYMBOLS, IMPACT_LINES = 10, 3, 3, 5, 5

PART = [*PR, "part"]


def _counts() -> Column:
    return F.concat(F.lit("(+"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")"))


def with_size_class(pr_files: DataFrame) -> DataFrame:
    """Normalise NULLs, cut the patch for quoting, and mark small changes."""
    patch = F.coalesce("patch", F.lit(""))
    return (
        pr_files.withColumn("additions", F.coalesce("additions", F.lit(0).cast("bigint")))
        .withColumn("deletions", F.coalesce("deletions", F.lit(0).cast("bigint")))
        .withColumn("truncated", F.length(patch) > PATCH_CHARS)
        .withColumn("patch", F.substring(patch, 1, PATCH_CHARS))
        .withColumn(
            "size_class",
            F.when(F.col("additions") + F.col("deletions") < SMALL_CHANGE_LINES, "small").otherwise("large"))
    )


def with_structures(pr_files: DataFrame, structures: DataFrame | None) -> DataFrame:
    if structures is None:
        return pr_files.withColumn("structure", F.lit(""))
    joined = pr_files.join(structures.select("repo", "file_path", "structure"), ["repo", "file_path"], "left")
    return joined.withColumn("structure", F.coalesce("structure", F.lit("")))


def _simple_summary() -> Column:
    context = F.when(F.col("structure") != "", F.concat(F.lit("\n\nContext: "), F.col("structure"))).otherwise("")
    return F.concat(
        F.lit("**"), F.col("file_path"), F.lit("** "), _counts(),
        F.lit("\n\nDiff content:\n```\n"), F.col("patch"), F.lit("\n```"), context,
    )


def file_summaries(pr_files: DataFrame, structures: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """One summary per changed file.

    `written` may hold model texts (repo, pr_id, file_ord, text) for large changes; without a text
    a large change is summarised like a small one.
    """
    files = with_structures(with_size_class(pr_files), structures)
    summary = _simple_summary()
    if written is not None:
        files = files.join(written.select(*PR, "file_ord", F.col("text").alias("_text")), [*PR, "file_ord"], "left")
        model = F.concat(F.lit("**"), F.col("file_path"), F.lit("** "), _counts(), F.lit("\n"), F.col("_text"))
        summary = F.when((F.col("size_class") == "large") & F.col("_text").isNotNull(), model).otherwise(summary)
    return files.select(
        *PR, "file_ord", "file_path", "additions", "deletions", "size_class", "truncated", summary.alias("summary"))


def summary_requests(pr_files: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """Data part of the request for a model text, for large changes only."""
    files = with_structures(with_size_class(pr_files).where(F.col("size_class") == "large"), structures)
    note = F.when(F.col("truncated"), " (truncated)").otherwise("")
    structure = F.when(F.col("structure") != "", F.col("structure")).otherwise("N/A")
    request = F.concat(
        F.lit("File: "), F.col("file_path"), F.lit(" "), _counts(), note,
        F.lit("\n\nCode Structure:\n"), structure, F.lit("\n\nDiff:\n```\n"), F.col("patch"), F.lit("\n```"),
    )
    return files.select(*PR, "file_ord", "file_path", request.alias("request"))


def fix_candidates(pr_files: DataFrame, issues: DataFrame) -> DataFrame:
    """Code to show for a fix: the first three files of changes with issues, if they have a patch."""
    patch = F.substring(F.col("patch"), 1, FIX_PATCH_CHARS)
    first = pr_files.where(F.col("file_ord") < FIX_FILES).select(*PR, "file_ord", "file_path", patch.alias("patch"))
    return first.where(F.col("patch") != "").join(issues.select(*PR).distinct(), PR, "left_semi").select(
        "*",
        F.concat(F.lit("### "), F.col("file_path"), F.lit("\n```diff\n"), F.col("patch"), F.lit("\n```")).alias("snippet"),
    )


def fix_requests(candidates: DataFrame, issue_lists: DataFrame) -> DataFrame:
    """Data part of the request for a fix: code of the first files and the issues, per part."""
    code = candidates.groupBy(*PR).agg(F.array_sort(F.collect_list(F.struct("file_ord", "snippet"))).alias("_s"))
    snippets = F.array_join(F.transform("_s", lambda s: s["snippet"]), "\n")
    bullets = F.array_join(F.transform("security_issues", lambda i: F.concat(F.lit("- "), i)), "\n")
    return issue_lists.join(code, PR).select(
        *PART, F.concat(F.lit("## Files Changed\n"), snippets, F.lit("\n\n## Security Issues\n"), bullets).alias("request"))


def retrieval_query_text(first_symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Search text per change: up to five function and class names and three summary heads."""
    names = first_symbols.groupBy(*PR).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "function", F.col("name")))).alias("functions"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "class", F.col("name")))).alias("classes"),
    )
    heads = (
        summaries.where((F.col("file_ord") < QUERY_FILES) & (F.col("summary") != ""))
        .groupBy(*PR)
        .agg(F.array_sort(F.collect_list(
            F.struct("file_ord", F.substring("summary", 1, QUERY_SUMMARY_CHARS).alias("head")))).alias("_heads"))
    )
    listed = lambda label, col: F.when(
        F.size(col) > 0, F.concat(F.lit(label), F.array_join(F.slice(col, 1, QUERY_SYMBOLS), ", ")))
    return names.join(heads, PR, "full").select(
        *PR,
        F.concat_ws(
            "\n", listed("Functions: ", "functions"), listed("Classes: ", "classes"),
            F.array_join(F.transform("_heads", lambda h: h["head"]), "\n"),
        ).alias("query_text"),
    )


def badge(score: Column, level: Column, issue_count: Column) -> Column:
    colour = F.lit("🟢")
    for bound, mark in reversed(rules.BADGES):
        colour = F.when(score >= bound, F.lit(mark)).otherwise(colour)
    issues = F.when(
        issue_count > 0,
        F.concat(F.lit("\n⚠️ **"), issue_count.cast("string"), F.lit(" security issue(s) detected**"))).otherwise("")
    return F.concat(
        F.lit("## "), colour, F.lit(" Risk Score: "), score.cast("string"), F.lit("/100 ("), level, F.lit(")"), issues)


def impact_texts(impact: DataFrame) -> DataFrame:
    """Bullet list of the first impacted files of each change; rows per change are bounded by the search."""
    line = F.concat(
        F.lit("- `"), F.col("file"), F.lit("` may be affected by changes to `"), F.col("symbol"), F.lit("`"))
    lists = impact.groupBy(*PR).agg(F.array_sort(F.collect_list(F.struct("impact_ord", line.alias("line")))).alias("_l"))
    return lists.select(
        *PR, F.array_join(F.transform(F.slice("_l", 1, IMPACT_LINES), lambda e: e["line"]), "\n").alias("impact_text"))


def context_texts(context: DataFrame) -> DataFrame:
    """Related code of each change (at most three chunks) as text."""
    entry = F.concat(
        F.lit("\n**`"), F.col("file"), F.lit("`** (relevance: "), F.format_string("%.2f", F.col("relevance")),
        F.lit(")\n```\n"), F.substring("content", 1, CONTEXT_CHARS), F.lit("\n```"),
    )
    lists = context.groupBy(*PR).agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("_l"))
    return lists.select(
        *PR,
        F.concat(
            F.lit("The following related code was found in the codebase:\n"),
            F.array_join(F.transform("_l", lambda e: e["entry"]), "\n")).alias("context_text"),
    )


def issue_texts(issue_lists: DataFrame) -> DataFrame:
    bullets = F.transform("security_issues", lambda i: F.concat(F.lit("- "), i))
    return issue_lists.select(
        *PART, F.concat(F.lit("⚠️ **SECURITY ISSUES FOUND:**\n"), F.array_join(bullets, "\n")).alias("issues_text"))


def summary_parts(summaries: DataFrame) -> DataFrame:
    """Ordered concatenation of summaries and of file lines, per part."""
    return (
        summaries.groupBy(*PR, part_of(F.col("file_ord")).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(
            "file_ord", "summary",
            F.concat(F.lit("- "), F.col("file_path"), F.lit(" "), _counts(), F.lit("\n")).alias("line"),
        ))).alias("_files"))
        .select(
            *PART,
            F.array_join(F.transform("_files", lambda f: f["summary"]), "\n\n").alias("summaries_text"),
            F.array_join(F.transform("_files", lambda f: f["line"]), "").alias("files_text"),
        )
    )


def spread_over_parts(per_change: DataFrame, occupied: DataFrame, first_only: list[str]) -> DataFrame:
    """Repeat change-level rows once per part that has rows, so parts of a large change join on their own keys.

    `occupied` has the keys of such parts; `file_ord` may have gaps. A change without any has part 0.
    The long columns of `first_only` stay with the first part.
    """
    parts = occupied.select(*PART).distinct()
    ends = parts.groupBy(*PR).agg(F.min("part").alias("first_part"), F.max("part").alias("last_part"))
    zero = F.lit(0).cast("bigint")
    rows = per_change.join(ends, PR, "left").join(parts, PR, "left").withColumns(
        {name: F.coalesce(name, zero) for name in ("part", "first_part", "last_part")})
    return rows.withColumns({name: F.when(F.col("part") == F.col("first_part"), F.col(name)) for name in first_only})


def report(
    risk: DataFrame, summaries: DataFrame, issue_lists: DataFrame,
    impact: DataFrame | None = None, context: DataFrame | None = None, unindexed: DataFrame | None = None,
    reviews: DataFrame | None = None, fixes: DataFrame | None = None,
) -> DataFrame:
    """Report sections and review body of every part of every change.

    `unindexed` lists repositories (repo) without any chunk, for the hint in the context section.
    `reviews` and `fixes` may hold model texts (repo, pr_id, text), one per change: a review text
    takes the place of the file listing, a fix is appended to the last part.
    """
    changes = risk.select(*PR, "changed_files_count", "missing_tests", "score", "level", "issue_count")
    for extra, name in ((impact_texts(impact) if impact is not None else None, "impact_text"),
                        (context_texts(context) if context is not None else None, "context_text")):
        changes = changes.withColumn(name, F.lit(None).cast("string")) if extra is None else changes.join(extra, PR, "left")
    if unindexed is None:
        changes = changes.withColumn("_unindexed", F.lit(False))
    else:
        flag = unindexed.select("repo").distinct().withColumn("_unindexed", F.lit(True))
        changes = changes.join(flag, "repo", "left").withColumn("_unindexed", F.coalesce("_unindexed", F.lit(False)))
    for texts, name in ((reviews, "_review"), (fixes, "_fix")):
        if texts is None:
            changes = changes.withColumn(name, F.lit(None).cast("string"))
        else:
            changes = changes.join(texts.select(*PR, F.col("text").alias(name)), PR, "left")
    changes = changes.withColumn("_written", F.col("_review").isNotNull())
    rows = (
        spread_over_parts(
            changes, summaries.select(*PR, part_of(F.col("file_ord")).alias("part")).union(issue_lists.select(*PART)),
            ["impact_text", "context_text", "_review"])
        .join(summary_parts(summaries), PART, "left")
        .join(issue_texts(issue_lists), PART, "left")
    )
    first, last = F.col("part") == F.col("first_part"), F.col("part") == F.col("last_part")
    review = F.concat(
        F.when(first, F.concat(
            F.lit("## PR Review (Fallback Mode)\n\n**Risk Level**: "), F.col("level"), F.lit("\n\n### Files Changed\n"),
        )).otherwise(""),
        F.coalesce("files_text", F.lit("")),
        F.when(
            last & F.col("missing_tests"),
            "\n⚠️ **Warning**: No tests were modified. Consider adding tests for the new code.",
        ).otherwise(""),
    )
    body = F.when(~F.col("_written"), review).otherwise(F.coalesce("_review", F.lit("")))
    wanted = last & F.col("_fix").isNotNull() & ~F.contains(F.lower("_fix"), F.lit("no fixes needed"))
    suggestion = F.when(wanted, F.concat(F.lit("\n\n---\n\n## 🔧 Suggested Fix\n\n"), F.col("_fix"))).otherwise("")
    no_context = F.when(
        F.col("_unindexed"), "⚠️ Codebase not indexed yet. Run indexing for better context.",
    ).otherwise("No additional context found.")
    header = badge(F.col("score"), F.col("level"), F.col("issue_count"))
    return rows.select(
        *PART,
        F.coalesce("summaries_text", F.lit("No file summaries available.")).alias("summaries_text"),
        F.when(F.col("issue_count") > 0, F.coalesce("issues_text", F.lit("")))
        .otherwise("✅ No security issues detected.").alias("issues_text"),
        # Sections about the whole change stand in its first part only.
        F.when(first, F.coalesce("impact_text", F.lit("No cross-file impacts detected."))).otherwise("").alias("impact_text"),
        F.when(first, F.coalesce("context_text", no_context)).otherwise("").alias("context_text"),
        # A listing in place of a review text comes without the badge.
        F.concat(F.when(first & F.col("_written"), F.concat(header, F.lit("\n\n---\n\n"))).otherwise(""), body, suggestion).alias("body"),
    )


def bodies(report: DataFrame, page_chars: int | None = None) -> DataFrame:
    """The review body of every change as one text, from the parts of `report`: repo, pr_id, page, body.

    With `page_chars` a new page begins with the part before which the text has passed a multiple of it, so a change of any
    size has pages of that length and one part more at most; pages joined in order are the one text.
    Pages are found from the lengths of parts alone.
    """
    before = F.sum(F.length("body")).over(Window.partitionBy(*PR).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    page = F.lit(0) if page_chars is None else F.floor(F.coalesce(before, F.lit(0)) / page_chars)
    parts = F.sort_array(F.collect_list(F.struct("part", "body")))
    return (
        report.select(*PART, "body").withColumn("page", page.cast("bigint")).groupBy(*PR, "page")
        .agg(F.array_join(F.transform(parts, lambda p: p["body"]), "").alias("body"))
    )

"""Review of many change requests in one plan."""

from pyspark.sql import DataFrame, functions as F

from codetide.operators import impact, retrieval, review, risk

PR = ["repo", "pr_id"]


def assemble(
    pr_files: DataFrame, repo_files: DataFrame, chunks: DataFrame, pr_vectors: DataFrame,
    pack="default", written=None, keep=lambda df, _: df,
) -> dict[str, DataFrame]:
    """All tables of a review, by name. Every branch is aggregated per change before it is joined.

    `repo_files` holds current sources, `chunks` the index, `pr_vectors` (repo, pr_id, embedding)
    the query vector of each change, `written` optional model summaries. `keep(df, name)` may
    materialise the stages that feed several tables. Sources and chunks of repositories without a
    change are dropped by a semi-join first.
    """
    repos = pr_files.select("repo").distinct()
    repo_files, chunks = (table.join(repos, "repo", "left_semi") for table in (repo_files, chunks))
    wide = keep(impact.symbol_table(impact.changed_sources(pr_files, repo_files)), "symbols")
    symbols = impact.pr_symbols(pr_files, wide)
    summaries = review.file_summaries(pr_files, impact.file_structures(wide), written)
    impacted = keep(impact.impact_analysis(pr_files, repo_files, symbols, keep), "impact")
    context = keep(retrieval.retrieve_context(chunks, pr_vectors, pr_files), "context")
    scanned = keep(risk.scan_files(pr_files, pack), "scanned")
    scored = risk.gate(risk.pr_risk(scanned, impacted, pack))
    issues = risk.issue_lists(scanned, pack)
    unindexed = pr_files.select("repo").distinct().join(chunks.select("repo").distinct(), "repo", "left_anti")
    return {
        "symbols": symbols,
        "summaries": summaries,
        "impact": impacted,
        "context": context,
        "risk": scored,
        "issues": issues,
        "report": review.report(scored, summaries, issues, impacted, context, unindexed),
    }


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts and verdict per change."""
    context = tables["context"].groupBy(*PR).agg(F.count(F.lit(1)).alias("context_chunks"))
    return (
        tables["risk"].join(context, PR, "left").fillna(0, ["context_chunks"])
        .select(
            *PR, "changed_files_count", "total_additions", "total_deletions", "tests_modified", "missing_tests",
            "impacted_files", "issue_count", "context_chunks", "score", "level", "state", "description")
    )


def query_texts(pr_files: DataFrame, symbols: DataFrame, summaries: DataFrame) -> DataFrame:
    """Search text of every change, the input of an embedder."""
    first = impact.first_symbols(symbols, review.QUERY_SYMBOLS, review.QUERY_SYMBOLS)
    return review.retrieval_query_text(first, summaries)


def embed_queries(texts: DataFrame, embed) -> DataFrame:
    """Query vectors (repo, pr_id, embedding); changes without text get none."""
    asked = texts.where(F.col("query_text") != "").select(*PR, F.col("query_text").alias("content"))
    return embed(asked).select(*PR, "embedding").where(F.size("embedding") > 0)



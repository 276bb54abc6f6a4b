"""Related code of changes: top-5 chunks of the repository, minus the change's own files, first 3."""

from pyspark.sql import DataFrame, Window, functions as F

from codetide.operators import similarity

PR = ["repo", "pr_id"]

# Retrieval depth and text length.
SEARCH_DEPTH, KEPT, CONTENT_CHARS = 5, 3, 500


def retrieve_context(chunks: DataFrame, pr_vectors: DataFrame, pr_files: DataFrame) -> DataFrame:
    """Context rows (repo, pr_id, rank, file, chunk_type, name, content, relevance, distance) for changes with a query vector.

    The change's own files are removed after the search, so fewer than three rows may remain.
    """
    keyed = chunks.withColumn("id", F.concat_ws(":", "file_path", F.col("chunk_index").cast("string")))
    queries = pr_vectors.select("repo", F.col("pr_id").cast("string").alias("query_id"), "embedding")
    found = similarity.top_k(keyed, queries, SEARCH_DEPTH, chunk_ord="chunk_index")
    hits = found.select(
        "repo", F.col("query_id").cast("bigint").alias("pr_id"), F.col("rank").alias("_found"), "similarity", "id",
        F.expr("substring_index(id, ':', size(split(id, ':')) - 1)").alias("file_path"))
    outside = hits.join(pr_files.select(*PR, "file_path"), [*PR, "file_path"], "left_anti")
    ranked = outside.withColumn("rank", F.row_number().over(Window.partitionBy(*PR).orderBy("_found")))
    kept = ranked.where(F.col("rank") <= KEPT)
    # Texts are fetched for the few kept hits only.
    found = similarity.with_fields(kept.drop("file_path"), keyed)
    return found.select(
        *PR, "rank", F.col("file_path").alias("file"), "chunk_type", "name", F.substring("content", 1, CONTENT_CHARS).alias("content"),
        F.col("similarity").alias("relevance"), "distance")


def retrieval_status(changes: DataFrame, chunks: DataFrame, pr_vectors: DataFrame) -> DataFrame:
    """Per change: needs_indexing (empty index), no_vector (nothing to search with) or searched."""
    indexed = chunks.select("repo").distinct().withColumn("_indexed", F.lit(True))
    asked = pr_vectors.where(F.size("embedding") > 0).select(*PR).withColumn("_asked", F.lit(True))
    return (
        changes.select(*PR).distinct().join(indexed, "repo", "left").join(asked, PR, "left")
        .select(
            *PR,
            F.when(F.col("_indexed").isNull(), "needs_indexing").when(F.col("_asked").isNull(), "no_vector")
            .otherwise("searched").alias("status"))
    )

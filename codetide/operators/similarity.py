"""Exact cosine top-k inside each repository.

Vectors are dealt by ranges of repository, width and a hash of their id, so that those of a repository
lie together and a hot repository spreads over as many tasks as it fills, and are packed into
matrices of bounded height. Matrices of the same repository meet in an ordinary join, which Spark
broadcasts when the query side turns out small and sorts, shuffles and de-skews otherwise. Each pair of
matrices is scored in products that emit only what may still enter the top k, so row pairs are never produced.
"""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from codetide.functions import vectors

CHUNK_BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 2048


def _vectors(df: DataFrame, id_col: str, ord_col: str | None) -> DataFrame:
    order = F.col(ord_col).cast("bigint") if ord_col else F.lit(0).cast("bigint")
    return df.where(F.size("embedding") > 0).select(
        "repo", F.col(id_col).cast("string").alias("id"), order.alias("ord"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Matrices of at most `rows` vectors of one repository: about one per small repository."""
    keyed = df.withColumns({"dim": F.size("embedding"), "_spread": F.xxhash64("id")})
    dealt = keyed.repartitionByRange("repo", "dim", "_spread").sortWithinPartitions("repo", "dim")
    return dealt.drop("_spread").mapInArrow(vectors.pack_blocks(rows), vectors.BLOCK_FIELDS)


def top_k(
    chunks: DataFrame, queries: DataFrame, k: int = 5, *,
    chunk_id: str = "id", chunk_ord: str | None = None, query_id: str = "query_id", where=None,
) -> DataFrame:
    """The k most similar chunks of each query's repository.

    Returns repo, query_id, id, rank, similarity. Ties go by `chunk_ord`, then id. `where` is an
    optional metadata condition on chunks, applied before ranking.
    """
    if where is not None:
        chunks = chunks.where(where)
    chunk_blocks = _blocks(_vectors(chunks, chunk_id, chunk_ord), CHUNK_BLOCK_ROWS)
    query_blocks = _blocks(_vectors(queries, query_id, None), QUERY_BLOCK_ROWS).select(
        "repo", "dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    local = chunk_blocks.join(query_blocks, ["repo", "dim"]).mapInArrow(vectors.score_block_pairs(k), vectors.PAIR_FIELDS)
    order = Window.partitionBy("repo", "query_id").orderBy(F.col("similarity").desc(), "ord", "id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("repo", "query_id", "id", "rank", "similarity")
    )


def nearest(chunks: DataFrame, vector: list[float], k: int = 5, *, tie_breakers: list[str], where=None) -> DataFrame:
    """The k rows most similar to one vector, with their other columns: a scan without a shuffle of rows.

    Every batch keeps its own k best; the driver-side merge of the final top-k sees k rows per task.
    """
    if where is not None:
        chunks = chunks.where(where)
    fields = [f for f in chunks.schema.fields if f.name != "embedding"] + [T.StructField("similarity", T.DoubleType())]
    scored = chunks.where(F.size("embedding") > 0).mapInArrow(vectors.score_against(vector, k), T.StructType(fields))
    return scored.orderBy(F.col("similarity").desc(), *tie_breakers).limit(k)


def with_fields(hits: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits of `top_k` with the path, type, name and text of their chunks, and the distance."""
    fields = chunks.select("repo", F.col(id_col).cast("string").alias("id"), "file_path", "chunk_type", "name", "content")
    return with_distance(hits).join(fields, ["repo", "id"])


def with_distance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.lit(1.0) - F.col("similarity"))

"""Readers. Every schema is given, nothing is inferred."""

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from codetide import schemas
from codetide.operators.events import present


def read_repo_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below `root`, laid out as owner/name/path-in-repository, as rows of REPO_FILES.

    Contents that are not valid UTF-8 become NULL. Size filters and the choice of columns reach
    the source: without `content` no file is opened. `root` is an absolute path or URI.
    """
    base = re.sub(r"^[a-z0-9]+://[^/]*|^file:", "", root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path, text = F.col("path"), F.col("content").cast("string")
    parts = F.split(F.substring(path, F.instr(path, base) + F.lit(len(base)), F.length(path)), "/")
    return raw.select(
        F.concat_ws("/", parts[0], parts[1]).alias("repo"),
        F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.when(F.is_valid_utf8(text), text).alias("content"),
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, skip_corrupt: bool = False) -> DataFrame:
    """Parquet table of a known schema; empty if the path does not exist.

    With `skip_corrupt` unreadable files count as absent instead of failing the job.
    """
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", skip_corrupt).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


# Totals that a host states for a whole change, and their names on its files.
HOST_TOTALS = (("changed_files", "host_files"), ("additions", "host_additions"), ("deletions", "host_deletions"))


def _complete(installation: Column, repo: Column, pr_id: Column) -> Column:
    return present(installation, 0) & present(repo, "") & present(pr_id, 0)


def explode_pr_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(PR_FILES rows, rejected documents with `error`) from rows of PR_DOCUMENT."""
    complete = _complete(F.col("installation_id"), F.col("repo"), F.col("pr_id"))
    rejected = documents.where(~complete).select("repo", "pr_id", "head_sha", F.lit("Missing context data").alias("error"))
    totals = [(F.col(name) if name in documents.columns else F.lit(None)).cast("bigint").alias(alias) for name, alias in HOST_TOTALS]
    files = documents.where(complete).select("repo", "pr_id", *totals, F.posexplode("files").alias("file_ord", "f")).select(
        "repo", "pr_id", F.col("file_ord").cast("bigint").alias("file_ord"), F.col("f.filename").alias("file_path"),
        "f.status", "f.patch", "f.additions", "f.deletions",
        *[alias for _, alias in HOST_TOTALS])
    return files, rejected


def read_pr_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Change requests from JSON files, one document per line."""
    return explode_pr_documents(spark.read.schema(schemas.PR_DOCUMENT).json(path))


def read_events(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    """Webhook events from JSON lines, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schemas.EVENTS).options(**options).json(path)

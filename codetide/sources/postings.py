"""Token postings on disk: which Python file mentions an identifier, and how often.

Kept as the chunk index is: a log of segments under a manifest (`index_store`). An update reads the texts of
changed files only and appends their postings; impact then reads postings of the asked tokens in place of all
sources. Rows are dealt by ranges of repository, token and file, so row-group statistics find a token and the
postings of a popular one are spread over several tasks.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from codetide import schemas
from codetide.functions import paths
from codetide.operators import impact, indexing
from codetide.session import Stages
from codetide.sources import index_store

FILE = index_store.FILE
POSTINGS = index_store.Layout("postings", schemas.POSTINGS, ["repo", "symbol", "file_path"])
# Up to this many asked tokens become a filter of the scan; the rows are the same beyond it.
PUSHED = 1000


def load_postings(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """repo, file_path, symbol, mentions in force; of the tokens in `wanted` (repo, name) if given."""
    rows, _ = index_store.read_log(spark, path, index_store.segments(spark, path), layout=POSTINGS)
    if wanted is None:
        return rows
    asked = [r["name"] for r in wanted.select("name").distinct().limit(PUSHED + 1).collect()]
    if len(asked) <= PUSHED:
        rows = rows.where(F.col("symbol").isin(asked)) if asked else rows.where(F.lit(False))
    return rows


def update_postings(spark: SparkSession, path: str, files: DataFrame) -> None:
    """Bring new and changed Python files up to date (REPO_FILES columns).

    A file that is listed twice counts once, as in an index run; a file that cannot be decoded keeps its postings.
    """
    stages = Stages(spark)
    sources = files.fillna("", ["repo"]).where(paths.extension(F.col("file_path")) == "py")
    ledger = read_ledger(spark, path)
    listed = stages.keep(indexing.hashed_keys(sources), "hashed")
    changed = stages.keep(indexing.changed_keys(indexing.one_per_file(listed), ledger), "changed")
    contents = indexing.contents_of(sources, listed, changed, nothing_indexed=ledger.isEmpty())
    index_store.append(spark, path, changed.withColumn("removed", F.lit(False)), impact.token_postings(contents), POSTINGS)
    index_store.compact(spark, path, layout=POSTINGS)
    stages.clear()


def remove_postings(spark: SparkSession, path: str, removed: DataFrame) -> None:
    """Drop the postings of files (repo, file_path)."""
    index_store.remove_files(spark, path, removed)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """repo, file_path, content_hash of the files whose postings are held."""
    _, files = index_store.read_log(spark, path, index_store.segments(spark, path), layout=POSTINGS)
    return files.where(~F.coalesce("removed", F.lit(False))).drop("removed")

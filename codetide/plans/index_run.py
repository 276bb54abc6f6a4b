"""Full and incremental index runs over many repositories at once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codetide.operators import indexing
from codetide.session import Stages, materialise
from codetide.sources import index_store


def plan_run(
    files: DataFrame, ledger: DataFrame, embed: Callable[[DataFrame], DataFrame], full: bool = True, keep=lambda df, _: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new chunks, new hashes, outcome per file) of an index run.

    A full run filters by directory, type and size; an incremental run takes every given file.
    `keep(df, name)` may materialise the stages that feed several branches, so that no model call
    is repeated; without it the plan stays lazy.
    """
    candidates = indexing.eligible_files(files) if full else files
    listed = keep(indexing.hashed_keys(candidates), "hashed")
    hashed = indexing.one_per_file(listed)
    changed = keep(indexing.changed_keys(hashed, ledger), "changed")
    contents = indexing.contents_of(candidates, listed, changed, nothing_indexed=ledger.isEmpty())
    embedded = keep(indexing.cut_texts(embed(indexing.chunk_files(contents))), "embedded")
    new_chunks = indexing.to_index_rows(indexing.number_valid_chunks(embedded))
    return new_chunks, indexing.new_hashes(changed, new_chunks), indexing.label_run(files, hashed, new_chunks, full)


def repos_of(files: DataFrame, most: int = 1000) -> list[str] | None:
    """The repositories in `files` if they are few enough to be a scan's filter."""
    found = [r["repo"] for r in files.select("repo").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def run_index(
    spark: SparkSession, index_path: str, files: DataFrame, embed: Callable[[DataFrame], DataFrame], full: bool = True, repair: bool = False,
) -> DataFrame:
    """Index changed files into the store and return counts per repository.

    `repair` also re-indexes files whose chunks are missing.
    """
    stages = Stages(spark)
    files = files.fillna("", ["repo"])  # a repository without a name is the one named ''
    chunks, ledger = index_store.load_index(spark, index_path, repos=repos_of(files))
    if repair:
        ledger = index_store.repaired_ledger(chunks, ledger)
    new_chunks, new_hashes, labelled = plan_run(files, ledger, embed, full, keep=stages.keep)
    counts = materialise(indexing.run_stats(labelled), "counts")
    index_store.update_index(spark, index_path, new_chunks, new_hashes)
    index_store.compact(spark, index_path)
    stages.clear()
    return counts


def apply_changes(
    spark: SparkSession, index_path: str, changes: DataFrame, embed: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Incremental update from changed files (REPO_FILES columns and `status`).

    Files with status `removed` leave the index; all others are re-indexed if their hash changed.
    """
    removed = F.coalesce("status", F.lit("")) == "removed"
    index_store.remove_files(spark, index_path, changes.where(removed))
    return run_index(spark, index_path, changes.where(~removed).drop("status"), embed, False)

"""Continuous incremental index."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from codetide.plans.index_run import apply_changes
from codetide.session import Stages


def start_index(
    changes: DataFrame, index_path: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger,
) -> StreamingQuery:
    """Apply a stream of changed files (REPO_FILES columns, status, seq) to an index.

    Each micro-batch keeps one version of a file: the last by `seq` (a missing one is the earliest),
    of equal ones that with the largest content hash, so redelivered rows count once. A batch
    replayed after a failure finds its hashes already stored and changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        stages = Stages(batch.sparkSession)
        order = F.struct(F.coalesce("seq", F.lit(-(1 << 63))), F.xxhash64("content", "status"))
        row = F.struct(*[c for c in batch.columns if c not in ("repo", "file_path", "seq")])
        last = batch.fillna("", ["repo"]).groupBy("repo", "file_path").agg(F.max_by(row, order).alias("_row")).select("repo", "file_path", "_row.*")
        apply_changes(batch.sparkSession, index_path, stages.keep(last, "batch"), embed).write.format("noop").mode("overwrite").save()
        stages.clear()

    return (
        changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )

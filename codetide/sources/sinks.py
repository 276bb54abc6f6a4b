"""Sinks for reviews and statuses: append-only tables in a bounded number of shards of repositories."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from codetide import schemas


SHARDS = 32


def _append(rows: DataFrame, path: str) -> None:
    shard = F.pmod(F.xxhash64("repo"), F.lit(SHARDS)).cast("int")
    rows.withColumn("shard", shard).hint("rebalance", "shard").sortWithinPartitions("shard", "repo").write.mode("append").partitionBy("shard").parquet(path)


def write_reviews(reviews: DataFrame, path: str) -> None:
    _append(reviews.select(*schemas.REVIEWS.fieldNames()), path)


def write_statuses(statuses: DataFrame, path: str) -> None:
    _append(statuses.select(*schemas.STATUSES.fieldNames()), path)


def stream_to_table(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stateless stream to a parquet table, exactly once."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )

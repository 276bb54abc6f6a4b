"""Bounded, repeatable samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def sample(labels: DataFrame, doc: str, label: str, rows: int = SAMPLE) -> DataFrame:
    """__doc, label: at most `rows` labelled ids, those with the smallest hashes.

    Null ids and labels are left out; of several labels of one id the largest counts. The bound makes the
    result fit for a broadcast.
    """
    known = labels.select(F.col(doc).alias("__doc"), F.col(label).cast("int").alias("label")).where("__doc IS NOT NULL AND label IS NOT NULL")
    return known.groupBy("__doc").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__doc"), "__doc").limit(rows)

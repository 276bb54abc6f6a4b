"""A key with a third of all rows: joins split it, results stay whole."""

import contextlib

import pytest
from pyspark.sql import functions as F

from codetide.operators import review, similarity

# Small thresholds, so that test data counts as skewed; joins are shuffled.
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def settings(spark, conf):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collected(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot_repo(i):
    return F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (i % 40).cast("string")))


def test_search_in_a_hot_repository(spark):
    axes = [F.pmod(F.xxhash64("id", F.lit(a)), F.lit(2001)) - 1000.0 for a in range(32)]
    chunks = spark.range(0, 12000, 1, 16).select(hot_repo(F.col("id")).alias("repo"), F.col("id").cast("string").alias("id"), F.array(*axes).alias("embedding"))
    queries = spark.range(0, 900, 1, 4).select(hot_repo(F.col("id")).alias("repo"), F.col("id").cast("string").alias("query_id"), F.array(*axes).alias("embedding"))
    with settings(spark, SKEW_CONF):
        rows, plan = collected(similarity.top_k(chunks, queries, 2))
    assert "skew=true" in plan
    assert len(rows) == 2 * 900
    # Every query vector is among the chunks and finds itself first.
    assert all(r.id == r.query_id and r.similarity == pytest.approx(1.0, abs=1e-6) for r in rows if r["rank"] == 1)


def test_summaries_of_a_file_in_every_change(spark):
    i = F.col("id")
    files = spark.range(0, 90000, 1, 16).select(
        F.lit("o/r").alias("repo"), (i % 5000).alias("pr_id"), i.alias("file_ord"),
        F.when(i % 3 == 0, F.lit("package.json")).otherwise(F.concat(F.lit("f"), (i % 20000).cast("string"))).alias("file_path"),
        F.concat(F.lit("+x"), i.cast("string")).alias("patch"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"))
    structures = files.select("repo", "file_path").distinct().withColumn("structure", F.lit("Language: x"))
    with settings(spark, SKEW_CONF):
        rows, plan = collected(review.file_summaries(files, structures).select("file_ord", "summary"))
    assert "skew=true" in plan
    assert len({r.file_ord for r in rows}) == 90000 == len(rows)
    assert all(r.summary.endswith("Context: Language: x") for r in rows)

"""Answers of a model as a table: what was asked once is not asked again."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from codetide.session import Stages
from codetide.sources.readers import read_table


def remembered(
    ask: Callable[[DataFrame], DataFrame], path: str, *, request_col: str, answer_col: str, model: str = "", keep_request: bool = True,
    slice_rows: int = 10_000,
) -> Callable[[DataFrame], DataFrame]:
    """A model hook with a memory in the table at `path`.

    Answers are keyed by the hash of model name and request. Only distinct requests without an answer
    are asked, in slices of about `slice_rows` that are stored one by one: a run that fails, or is run again, goes on
    with the slices that are missing. Failures (null, empty vectors) are not stored, so they are asked
    next time. The table only grows; of answers that two runs stored for one request one is taken.
    """

    def run(df: DataFrame) -> DataFrame:
        spark, stages = df.sparkSession, Stages(df.sparkSession)
        request = F.coalesce(F.col(request_col), F.lit(""))
        keyed = df.withColumn("_key", F.sha2(F.concat(F.lit(f"{model}\0"), request), 256))
        kind = ask(keyed.select("_key", request_col)).schema[answer_col].dataType
        schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField(answer_col, kind)])
        known = read_table(spark, path, schema)
        distinct = keyed.groupBy("_key").agg(F.first(request_col).alias(request_col))
        missing = stages.keep(distinct.join(known.select("_key"), "_key", "left_anti"), "missing")
        slices = -(-missing.count() // slice_rows)
        answer = F.col(answer_col)
        good = F.size(answer) > 0 if isinstance(kind, T.ArrayType) else answer.isNotNull()
        for number in range(slices):
            part = missing.where(F.pmod(F.xxhash64("_key"), F.lit(slices)) == number)
            ask(part).where(good).select("_key", answer_col).write.mode("append").parquet(path)
        stages.clear()
        answers = read_table(spark, path, schema).dropDuplicates(["_key"])
        joined = keyed.join(answers, "_key", "left")
        if isinstance(kind, T.ArrayType):
            joined = joined.withColumn(answer_col, F.coalesce(answer_col, F.array().cast(kind)))
        return joined.select(*[c for c in df.columns if keep_request or c != request_col], answer_col)

    return run

"""Session helpers: suggested settings and reliable materialisation."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Engine settings the plans are written for. Shuffle partitions start high and AQE merges the small ones.
SUGGESTED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codetide-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Stages:
    """Expensive results that feed several branches, written once to the shared folder.

    The copies survive lost executors, keep column pruning and cut lineage. `keep` fits the `keep`
    argument of the plans; `clear` deletes the copies once the results have been consumed.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """One stage of its own, kept for as long as the caller needs it."""
    return Stages(df.sparkSession).keep(df, name)


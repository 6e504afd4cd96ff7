"""The Parquet tables of a folder, and results that outlast their lineage."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the folder that driver and executors share: spark.checkpoint.dir; a local master without one gets a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="docmill-"))
    return f"{spark.conf.get('spark.checkpoint.dir', None) or context._jsc.sc().getCheckpointDir().get()}/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def lasting(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the session's checkpoint folder."""
    shared_path(df.sparkSession, "")
    return df.checkpoint()

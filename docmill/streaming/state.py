"""Keyed state that batches are merged into: versioned, restartable, and written once for each batch."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.sources.tables import exists, shared_path, table

#: What is kept of a key: when it was first and last seen, how often, its newest value (of equal times the largest), and a flag that
#: stays set once any row has set it.
STATE = "key string, first_seen timestamp, last_seen timestamp, seen long, newest struct<at: timestamp, value: string>, flagged boolean"


def summed(rows: DataFrame) -> DataFrame:
    """The state of rows that are states themselves: the order in which they come, and how they are grouped, doesn't matter."""
    return rows.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen").alias("seen"), F.max("newest").alias("newest"), F.coalesce(F.max("flagged"), F.lit(False)).alias("flagged"))


def seen(rows: DataFrame) -> DataFrame:
    """A state for each row of rows (key, at, value, flagged); rows without a key are left out."""
    named = rows.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), "at", F.col("value").cast("string").alias("value"), F.coalesce("flagged", F.lit(False)).alias("flagged"))
    return named.select("key", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"), F.lit(1).cast("long").alias("seen"), F.struct("at", "value").alias("newest"), "flagged")


@dataclass
class StateStore:
    """State in the folder `root`, dealt over buckets by key. A batch rewrites the buckets of its keys as a new generation; the manifest,
    written last and at once, names the live generation of each bucket and the batch. A batch that the manifests name is not merged
    again, and a generation that no manifest names (its writer died) is never read, so that a batch takes effect once."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("bucket int, gen string, version int, batch string").parquet(f"{self.root}/manifest")

    def version(self) -> int:
        return (self._manifests().agg(F.max("version")).first()[0] or 0) if exists(self.spark, f"{self.root}/manifest") else 0

    def rows(self, version: int | None = None) -> DataFrame:
        """The state as of a version, by default the newest."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], f"{STATE}, bucket int")
        live = self._manifests().where(F.col("version") == version).where("bucket IS NOT NULL").select("bucket", "gen")
        return self.spark.read.schema(f"{STATE}, gen string, bucket int").parquet(f"{self.root}/rows").join(live, ["bucket", "gen"]).drop("gen")

    def merge(self, rows: DataFrame, batch: str) -> bool:
        """Merges rows (key, at, value, flagged) as the named batch; False if it has been merged before."""
        version = self.version()
        if version and not self._manifests().where(F.col("batch") == batch).isEmpty():
            return False
        gen = uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        new = summed(seen(rows)).withColumn("bucket", bucket)
        if version:
            touched = new.select("bucket").distinct()
            old = self.rows(version).join(touched, "bucket", "left_semi")
            new = summed(new.drop("bucket").unionByName(old.drop("bucket"))).withColumn("bucket", bucket)
        new.write.partitionBy("bucket").parquet(f"{self.root}/rows/gen={gen}")
        written = self.spark.read.schema(f"{STATE}, bucket int").option("basePath", f"{self.root}/rows/gen={gen}").parquet(f"{self.root}/rows/gen={gen}").select("bucket").distinct().withColumn("gen", F.lit(gen))
        if version:
            before = self._manifests().where(F.col("version") == version).where("bucket IS NOT NULL").select("bucket", "gen")
            written = written.unionByName(before.join(written.select("bucket"), "bucket", "left_anti"))
        # a batch without keys leaves its name alone
        written = written.unionByName(self.spark.sql("SELECT CAST(NULL AS INT) AS bucket, '' AS gen"))
        written.withColumn("version", F.lit(version + 1)).withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return True

    def follow(self, stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
        """Merges each micro-batch of a stream once, whatever is replayed after a restart."""
        return stream.writeStream.foreachBatch(lambda rows, i: self.merge(rows, f"{name}-{i}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_merge(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user after three batches of events, one of which comes twice."""
    store = StateStore(spark, shared_path(spark, f"state-{uuid.uuid4().hex}"), 8)
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("value"), (F.col("event_type") == "error").alias("flagged"))
    for part in (0, 1, 1, 2):
        store.merge(rows.where(F.col("event_id") % 3 == part), f"events-{part}")
    state = store.rows()
    micros = lambda c: F.unix_micros(F.col(c))
    return state.select(F.col("key").cast("long").alias("user_id"), micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"), "seen", F.col("newest.value").alias("newest"), "flagged")


QUERIES = {"state_merge": state_merge}
ORACLE_SQL = {
    "state_merge": """
SELECT user_id, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS seen, max({'at': ts, 'value': event_type}).value AS newest, max(event_type = 'error') AS flagged FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
}

"""Incremental ingest: new document versions of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_versions(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row of each (doc_id, content) of a stream of fetched documents (doc_id, text, ts); state older than delay goes.

    Rows that come later than the watermark are dropped by Spark; a version that comes back after the delay counts as new.
    """
    named = stream.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id", "sha256"])

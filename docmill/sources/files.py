"""JSON lines that are appended, and evaluation sets that are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An evaluation set: a description and its cases; fields that a case lacks are null but for top_k, which is then 5.
GOLD_SCHEMA = "description string, cases array<struct<case_id: string, query: string, top_k: int, expected_source_type: string, expected_document_title_contains: string, filter_source_type: string, filter_year: int, filter_topic: string>>"


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends one JSON object a row, nulls left out."""
    df.write.mode("append").json(path)


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of an evaluation set, in any of the files at path."""
    cases = spark.read.schema(GOLD_SCHEMA).option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    return cases.withColumn("top_k", F.coalesce("top_k", F.lit(5)))

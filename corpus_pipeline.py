"""A corpus pipeline: quality, lines, near copies, benchmark passages, then packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import NULL_ID, materialize
from docmill.llm.decontamination import decontaminate
from docmill.llm.line_dedup import drop_frequent_lines
from docmill.llm.packing import pack_documents, public_tokenizer
from docmill.llm.quality_classifier import fit, remainder, score_quality
from docmill.llm.simhash import SIMILAR, near_duplicates


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the documents in ids (doc_id)."""
    gone = ids.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_gone")).distinct()
    return docs.join(gone, F.coalesce(docs["doc_id"], F.lit(NULL_ID)) == gone["_gone"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject (score 0.5 or more).

    It learns from the labelled rows of docs of two folds of three, as the registered query does. Null and empty texts have a
    score like any other, rows that repeat a doc_id go together, an empty table stays empty, and all columns stay.
    """
    learn = remainder(3) != 1
    model = fit(docs.where(learn), spark.read.parquet(f"{sf_dir}/labels.parquet").where(learn))
    scored = score_quality(docs, model)
    return _without(docs, scored.where("score < 0.5"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them have; n_chars is that of the text that stays, maybe none.

    A null text becomes an empty one; rows that repeat a doc_id count as one document and all stay. Only the columns of
    documents stay.
    """
    kept = drop_frequent_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: five-word shingles, a similarity of 0.8 or more.

    A null doc_id is the smallest; empty texts are copies of each other. Of rows that repeat a doc_id and text, one stays (the
    first by lang, source and n_chars); other texts of a doc_id are the same document and stay with it. All columns stay.
    """
    found = near_duplicates(docs, SIMILAR)
    kept = _without(docs, found.where("not doc_id <=> component_id"))
    same = W.partitionBy("doc_id", F.xxhash64("text"), F.md5("text")).orderBy("lang", "source", "n_chars")
    return kept.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, and all columns stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end alone."""
    return pack_documents(docs, public_tokenizer())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("packing", packed)]
#: SQL can't express the compressors, SimHash, the banded alignment or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

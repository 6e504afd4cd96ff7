"""The best context near a place: a band join by offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.relational import run_statement
from docmill.plans.dialects import both

#: How far is near, and what a place is worth: 2 for a listed chunk, 1 for an overlap, up to .5 for a near one.
NEAR, LISTED, OVERLAP, CLOSE, SLOPE = 2200, 2.0, 1.0, 0.5, 5000.0


def best_contexts(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc, chunk, candidate, score): the best candidate (doc, candidate, start, end, confidence, listed: array of chunks) of each chunk
    (doc, chunk, start, end); ties go to the smaller candidate, chunks of a document without candidates have none.

    Chunks and candidates meet in buckets of NEAR characters: a candidate stands in all that it covers and in those next to them,
    a chunk in those of its ends and between, so that every pair within NEAR or with an overlap meets. Listed pairs are joined by name;
    where nothing is near, a document's surest candidate is left. No document's chunks and candidates are paired otherwise.
    """
    bucket = lambda c: F.floor(c / NEAR)
    a = chunks.select("doc", "chunk", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))).alias("b"))
    k = candidates.select("doc", "candidate", "start", "end", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "listed")
    placed = k.where("start IS NOT NULL AND end IS NOT NULL").select("*", F.explode(F.sequence(bucket(F.least("start", "end") - NEAR), bucket(F.greatest("start", "end") + NEAR))).alias("b"))
    met = a.join(placed, ["doc", "b"]).drop("b").distinct()
    gap = F.least(F.abs(F.col("c_start") - F.col("start")), F.abs(F.col("c_end") - F.col("end")))
    overlaps = (F.col("c_start") < F.col("end")) & (F.col("start") < F.col("c_end"))
    place = F.when(overlaps, OVERLAP).when(gap <= NEAR, F.greatest(F.lit(0.0), CLOSE - gap / SLOPE))
    near = met.select("doc", "chunk", "candidate", "confidence", place.alias("place")).where("place IS NOT NULL")
    named = k.select("doc", "candidate", "confidence", F.explode("listed").alias("chunk")).distinct().join(chunks.select("doc", "chunk"), ["doc", "chunk"])
    surest = k.groupBy("doc").agg(F.min(F.struct((-F.col("confidence")).alias("less"), "candidate", "confidence")).alias("x")).select("doc", "x.candidate", "x.confidence")
    parts = [
        near.select("doc", "chunk", "candidate", "confidence", "place", F.lit(0.0).alias("list")),
        named.select("doc", "chunk", "candidate", "confidence", F.lit(0.0).alias("place"), F.lit(LISTED).alias("list")),
        chunks.join(surest, "doc").select("doc", "chunk", "candidate", "confidence", F.lit(0.0).alias("place"), F.lit(0.0).alias("list")),
    ]
    each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc", "chunk", "candidate").agg(F.max("confidence").alias("confidence"), F.max("place").alias("place"), F.max("list").alias("list"))
    scored = each.withColumn("score", F.round(F.col("confidence") + F.col("list") + F.col("place") + 1e-9, 6))
    return scored.groupBy("doc", "chunk").agg(F.min(F.struct((-F.col("score")).alias("less"), "candidate", "score")).alias("x")).select("doc", "chunk", "x.candidate", "x.score")


_CHUNKS = "SELECT doc_id AS doc, CAST(k AS BIGINT) AS chunk, CAST(k * 750 AS BIGINT) AS start, CAST(least(k * 750 + 900, n) AS BIGINT) AS `end` FROM (SELECT doc_id, length(text) AS n, EXPLODE(SEQ(0, CAST(floor(greatest(length(text) - 1, 0) / 750) AS INT))) AS k FROM documents) AS c"
_LINES = """SELECT doc, pos AS candidate, start, start + length(line) AS `end`, round(least(#1, length(line) / #300), 6) AS confidence, CASE WHEN pos % 11 = 3 THEN SEQ(0, 1) END AS listed
FROM (SELECT doc, pos, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id AS doc, POSEX(SPLIT(text, NEWLINE); pos, line) FROM documents) AS r) AS l WHERE HAS(line, R'[0-9|]')"""
_PAIRS = [both(s) for s in (_CHUNKS, _LINES)]


def best_lines(spark: SparkSession, d: str) -> DataFrame:
    """The best line with a digit or a bar for each chunk of 900 characters, of all lines within 2200 characters, those that list it, and
    the document's surest."""
    chunks, lines = (run_statement(spark, d, p[0]) for p in _PAIRS)
    found = best_contexts(chunks, lines.withColumn("listed", F.expr("transform(listed, x -> CAST(x AS BIGINT))")))
    return found.select(F.col("doc").alias("doc_id"), "chunk", F.col("candidate").cast("long").alias("line"), "score")


QUERIES = {"best_lines": best_lines}
_C, _L = (p[1].replace("`end`", "end_") for p in _PAIRS)
ORACLE_SQL = {
    # every line of a document against every chunk of it
    "best_lines": f"""
WITH c AS ({_C}), l AS ({_L}), s AS (SELECT c.doc AS doc_id, c.chunk, l.candidate AS line, round(l.confidence + CASE WHEN list_contains(coalesce(l.listed, []), c.chunk) THEN 2 ELSE 0 END + CASE WHEN c.start < l.end_ AND l.start < c.end_ THEN 1
WHEN least(abs(c.start - l.start), abs(c.end_ - l.end_)) <= 2200 THEN greatest(0, 0.5::DOUBLE - least(abs(c.start - l.start), abs(c.end_ - l.end_)) / 5000::DOUBLE) ELSE 0 END + 0.000000001::DOUBLE, 6) AS score FROM c JOIN l ON c.doc = l.doc)
SELECT doc_id, chunk, line, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, chunk ORDER BY score DESC, line) = 1""",
}

"""Pages, quality, sections and chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import cleaned_lines, normalized, trigrams
from docmill.sources.tables import table


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(cleaned_lines(F.col("text")), 256).alias("clean_sha256"), F.length(normalized(F.col("text"))).cast("long").alias("norm_chars"))


def pages(docs: DataFrame, separator: str = "\n", gap: int = 2) -> DataFrame:
    """(doc_id, page, start_offset, end_offset) of the non-empty pages of texts joined by `gap` characters; pages count from 1 and empty ones take up their gap."""
    page = docs.select("doc_id", F.posexplode(F.split("text", separator, -1)).alias("pos", "body"))
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("body") + gap).over(before), F.lit(0))
    out = page.select("doc_id", (F.col("pos") + 1).cast("long").alias("page"), start.cast("long").alias("start_offset"), (start + F.length("body")).cast("long").alias("end_offset"))
    return out.where("end_offset > start_offset")


def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(table(spark, d, "documents"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    """An extraction score from 0 to 1, with flags: too short, few letters, many empty pages; a candidate for OCR under 0.55."""
    text = F.trim("text")
    n = F.length(text)
    letters = n - F.length(F.regexp_replace(text, "[\\p{L}]", ""))
    lines = F.split("text", "\n", -1)
    full = F.size(F.filter(lines, lambda x: F.trim(x) != "")) / F.size(lines)
    flags = {"TOO_SHORT": n < 400, "REPLACEMENT": F.contains(text, F.lit("�")), "FEW_LETTERS": letters / F.greatest(n, F.lit(1)) < 0.2, "EMPTY_PAGES": full < 0.6}
    cost = {"TOO_SHORT": 0.35, "REPLACEMENT": 0.15, "FEW_LETTERS": 0.25, "EMPTY_PAGES": 0.15}
    score = F.lit(1.0)
    for name, flag in flags.items():
        score = score - F.when(flag, cost[name]).otherwise(0.0)
    score = F.when(n == 0, 0.0).otherwise(F.greatest(score, F.lit(0.0)))
    named = [F.when(flag, name) for name, flag in flags.items()] + [F.when(flags["TOO_SHORT"] | (score < 0.55), "OCR_CANDIDATE")]
    return table(spark, d, "documents").select("doc_id", F.round(score, 4).alias("score"), F.array_join(F.array_sort(F.array_compact(F.array(*named))), ",").alias("flags"))


def chunks(docs: DataFrame, size: int = 900, stride: int = 750) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, chunk_id): windows of `size` characters; the last one reaches the end; blank ones are dropped."""
    n = F.length("text")
    starts = F.when(n > size, F.sequence(F.lit(0), n - size + stride - 1, F.lit(stride))).otherwise(F.array(F.lit(0)))
    out = docs.where(n > 0).select("doc_id", "text", F.explode(starts).alias("start"))
    end = F.least(F.col("start") + size, F.length("text"))
    body = F.substring("text", F.col("start") + 1, end - F.col("start"))
    out = out.select("doc_id", F.col("start").cast("long").alias("start_offset"), end.cast("long").alias("end_offset"), normalized(body).alias("body")).where("body <> ''")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("start_offset")) - 1
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start_offset").cast("string"), F.col("end_offset").cast("string"), "body")
    return out.select("doc_id", index.cast("long").alias("chunk_index"), "start_offset", "end_offset", F.substring(F.sha2(name, 256), 1, 40).alias("chunk_id"))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(table(spark, d, "documents"))


def text_sections(spark: SparkSession, d: str) -> DataFrame:
    """Spans from heading to heading (a line of up to 80 characters that doesn't end in a full stop); text before the first one is in none."""
    line = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    order = W.partitionBy("doc_id").orderBy("pos")
    start = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = line.withColumn("start", start).withColumn("stop", F.col("start") + F.length("line"))
    line = line.withColumn("text_end", F.max("stop").over(W.partitionBy("doc_id")))
    heading = line.where("length(trim(line)) between 1 and 80 and not endswith(trim(line), '.')")
    after = F.lead("start").over(W.partitionBy("doc_id").orderBy("pos"))
    return heading.select("doc_id", F.col("start").cast("long").alias("start_offset"), F.coalesce(after, "text_end").cast("long").alias("end_offset"))


def text_trigrams(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select(F.explode(trigrams(F.col("text"))).alias("trigram"))
    return found.groupBy("trigram").agg(F.count(F.lit(1)).alias("n_docs"))


NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
CLEAN = "array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
TRIGRAMS = "CASE WHEN length(n) >= 3 THEN list_distinct(list_transform(range(1, length(n) - 1), lambda i: substr(n, i, 3))) WHEN n <> '' THEN [n] ELSE [] END"
LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"

QUERIES = {f.__name__: f for f in (text_normalize, text_pages, text_quality, text_chunks, text_sections, text_trigrams)}
ORACLE_SQL = {
    "text_normalize": f"SELECT doc_id, sha256({CLEAN}) AS clean_sha256, length({NORM.format('text')}) AS norm_chars FROM documents",
    "text_pages": f"""
WITH l AS ({LINES}), o AS (SELECT doc_id, pos, length(line) AS n, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM l)
SELECT doc_id, pos + 1 AS page, s AS start_offset, s + n AS end_offset FROM o WHERE n > 0""",
    "text_quality": """
WITH f AS (
  SELECT doc_id, length(trim(text)) AS n, length(trim(text)) - length(regexp_replace(trim(text), '\\p{L}', '', 'g')) AS letters, contains(trim(text), chr(65533)) AS bad,
         len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) / len(string_split(text, chr(10))) AS filled FROM documents),
s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(1.0::DOUBLE - CASE WHEN n < 400 THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN bad THEN 0.15::DOUBLE ELSE 0 END
  - CASE WHEN letters / greatest(n, 1) < 0.2 THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN filled < 0.6 THEN 0.15::DOUBLE ELSE 0 END, 0) END AS score FROM f)
SELECT doc_id, round(score, 4) AS score, array_to_string(list_sort(list_filter([CASE WHEN n < 400 THEN 'TOO_SHORT' END, CASE WHEN bad THEN 'REPLACEMENT' END,
  CASE WHEN letters / greatest(n, 1) < 0.2 THEN 'FEW_LETTERS' END, CASE WHEN filled < 0.6 THEN 'EMPTY_PAGES' END, CASE WHEN n < 400 OR score < 0.55 THEN 'OCR_CANDIDATE' END],
  lambda x: x IS NOT NULL)), ',') AS flags FROM s""",
    "text_chunks": f"""
WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) > 900 THEN range(0, length(text) - 900 + 750, 750) ELSE [0] END) AS s FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, s, least(s + 900, length(text)) AS e, {NORM.format('substr(text, s + 1, least(900, length(text) - s))')} AS body FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS start_offset, e AS end_offset,
       substr(sha256(concat_ws(':', doc_id, s, e, body)), 1, 40) AS chunk_id FROM c WHERE body <> ''""",
    "text_sections": f"""
WITH l AS ({LINES}), o AS (SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM l),
t AS (SELECT *, max(s + length(line)) OVER (PARTITION BY doc_id) AS e FROM o)
SELECT doc_id, s AS start_offset, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY pos), e) AS end_offset FROM t
WHERE length(trim(line)) BETWEEN 1 AND 80 AND NOT ends_with(trim(line), '.')""",
    "text_trigrams": f"SELECT trigram, count(*) AS n_docs FROM (SELECT unnest({TRIGRAMS}) AS trigram FROM (SELECT {NORM.format('text')} AS n FROM documents)) GROUP BY 1",
}

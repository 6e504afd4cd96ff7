"""Searches that labels lift or filter, and the fusion of hit lists into the contexts of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import normalized, tokens
from docmill.operators.search import BLOCK, ORACLE_SQL as SEARCH_SQL
from docmill.operators.search import documents_index, hybrid_candidates
from docmill.sources.tables import lasting, table

#: What a label's best match and its best specificity add to a score, and how many texts stand in for no candidates.
OVERLAP_WEIGHT, SPECIFICITY_WEIGHT, FALLBACK = 0.25, 0.10, 100


def label_match(label: Column, other: Column) -> Column:
    """1 if equal, .92 if one holds the other, .55 + .35 of the shared words if these are three fifths of the larger set, else 0."""
    a, b = (F.array_distinct(F.split(x, " ")) for x in (label, other))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return F.when((label == "") | (other == ""), 0.0).when(label == other, 1.0).when(F.contains(label, other) | F.contains(other, label), 0.92).when(shared >= 0.6, 0.55 + 0.35 * shared).otherwise(0.0)


def with_fallback(found: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of found, and for queries that found nothing the first FALLBACK documents whose normalised text holds the
    normalised query, each as if ranked first. Only such queries are held against the texts, BLOCK at a time."""
    asked = queries.select("item_id", normalized(F.col("text")).alias("q")).where("q <> ''")
    lost = lasting(asked.join(found.select("item_id").distinct(), "item_id", "left_anti"))
    out, n = found.select("item_id", "doc_id", "score"), -(-lost.count() // BLOCK)
    texts = docs.select("doc_id", normalized(F.col("text")).alias("n"))
    for block in range(n):
        part = lost.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block)
        hits = texts.join(F.broadcast(part), F.contains("n", "q")).select("item_id", "doc_id")
        nth = F.row_number().over(W.partitionBy("item_id").orderBy("doc_id"))
        out = out.unionByName(hits.withColumn("nth", nth).where(F.col("nth") <= FALLBACK).select("item_id", "doc_id", F.lit(0.72).alias("score")))
    return out


def labelled_search(found: DataFrame, queries: DataFrame, links: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, doc_id, rank, score, matches, boost) of found (item_id, doc_id, score), lifted by the labels that documents are linked
    to; links: doc_id, label, confidence, specificity; queries: item_id, text, label, mode.

    A label matches the query, or the query's own label if it names one. `off` leaves scores alone, `boost` (also any other mode) adds
    .25 of the best confidence times match and .10 of the best specificity of matching labels, up to 1, and `filter` keeps only
    documents with a match if the query names a label. Ties go to the smaller doc_id.
    """
    asked = queries.select("item_id", normalized(F.col("text")).alias("q"), F.coalesce(normalized(F.col("label")), F.lit("")).alias("own"), F.lower(F.trim(F.coalesce("mode", F.lit("boost")))).alias("mode"))
    rows = found.join(asked, "item_id")
    against = F.when((F.col("own") != "") & (F.col("mode") != "off"), F.col("own")).otherwise(F.col("q"))
    linked = rows.select("item_id", "doc_id", against.alias("against")).join(links.select("doc_id", normalized(F.col("label")).alias("name"), "confidence", "specificity"), "doc_id")
    linked = linked.withColumn("match", label_match(F.col("name"), F.col("against"))).where("match > 0")
    best = linked.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matches"), F.max(F.col("confidence") * F.col("match")).alias("overlap"), F.max("specificity").alias("specificity"))
    rows = rows.join(best, ["item_id", "doc_id"], "left").na.fill(0, ["matches", "overlap", "specificity"])
    rows = rows.where(~((F.col("mode") == "filter") & (F.col("own") != "") & (F.col("matches") == 0)))
    boost = F.when(F.col("mode") == "off", 0.0).otherwise(OVERLAP_WEIGHT * F.col("overlap") + SPECIFICITY_WEIGHT * F.col("specificity"))
    rows = rows.select("item_id", "doc_id", F.round(F.least(F.lit(1.0), F.col("score") + boost) + 1e-9, 6).alias("score"), "matches", F.round(boost + 1e-9, 6).alias("boost"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item whose id is divisible by 20, in one of three modes, and one that no index can answer."""
    items = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.unionByName(spark.sql("SELECT -1L AS item_id, '!!' AS text"))
    mode = F.expr("CASE pmod(item_id div 20, 3) WHEN 0 THEN 'boost' WHEN 1 THEN 'filter' ELSE 'off' END")
    return items.select("*", F.when(mode == "filter", "the").alias("label"), mode.alias("mode"))


def search_modes(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each query in its mode; a document's label is its first word."""
    docs, queries = table(spark, d, "documents"), lasting(_queries(spark, d))
    found = with_fallback(hybrid_candidates(documents_index(spark, d), queries), docs, queries)
    links = docs.select("doc_id", F.try_element_at(tokens(F.col("text")), F.lit(1)).alias("label"), (0.9 - F.pmod("doc_id", F.lit(5)) / 10.0).alias("confidence"), (F.pmod("doc_id", F.lit(7)) / 7.0).alias("specificity")).where("label IS NOT NULL")
    return labelled_search(found, queries, links)


def fuse(hits: DataFrame, candidates: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """(item_id, chunk, doc, kind, score, place): the contexts of each item out of several lists of hits.

    hits: item_id, chunk, doc, kind, score, of any list; a chunk that several lists hold counts once with its best score. candidates:
    the same columns with quality and decides, from which more may be taken. asked: item_id, kinds (none: all), broad.

    1. Hits of kinds that weren't asked for leave; a kind that was asked for and is missing brings its 3 * k best candidates.
    2. For a broad question with two or more protocols among the hits, each of the first k protocols is stood for by one chunk: its
       deciding candidate of the best quality, or its own hit of the best quality; its other hits leave.
    3. The k best by score stay; for a broad question the best chunk of every protocol comes before all others.
    Ties go to the smaller chunk.
    """
    columns = ["item_id", "chunk", "doc", "kind", "score"]
    wanted = F.col("kinds").isNull() | (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))
    best = hits.select(columns).groupBy("item_id", "chunk").agg(F.max(F.struct("score", "doc", "kind")).alias("x")).select("item_id", "chunk", "x.doc", "x.kind", "x.score")
    first = best.join(asked, "item_id").where(wanted).select(columns)
    lacking = asked.select("item_id", F.explode("kinds").alias("kind")).distinct().join(first.select("item_id", "kind").distinct(), ["item_id", "kind"], "left_anti")
    by_kind = W.partitionBy("item_id", "kind").orderBy(F.desc("score"), "chunk")
    more = candidates.join(lacking, ["item_id", "kind"]).withColumn("n", F.row_number().over(by_kind)).where(F.col("n") <= 3 * k)
    chosen = lasting(first.unionByName(more.select(columns)))

    quality = candidates.select("item_id", "chunk", "quality", "decides")
    rated = chosen.join(asked.select("item_id", "broad"), "item_id").join(quality, ["item_id", "chunk"], "left").na.fill(0.0, ["quality"])
    protocol = rated.where("broad AND kind = 'protocol'")
    docs = protocol.groupBy("item_id", "doc").agg(F.max(F.struct("score", -F.col("chunk"))).alias("x"))
    docs = docs.withColumn("n", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("x"), "doc"))).withColumn("all", F.count(F.lit(1)).over(W.partitionBy("item_id")))
    targets = lasting(docs.where((F.col("n") <= k) & (F.col("all") > 1)).select("item_id", "doc"))
    of = W.partitionBy("item_id", "doc").orderBy(F.desc("first"), F.desc("quality"), "chunk")
    deciding = candidates.where("decides AND kind = 'protocol'").select(*columns, "quality", F.lit(1).alias("first"))
    own = protocol.select(*columns, "quality", F.lit(0).alias("first"))
    stand = deciding.unionByName(own).join(targets, ["item_id", "doc"]).withColumn("n", F.row_number().over(of)).where("n = 1").select(columns)
    others = chosen.join(targets.withColumn("kind", F.lit("protocol")), ["item_id", "doc", "kind"], "left_anti").select(columns)
    whole = others.unionByName(stand).join(asked.select("item_id", "broad"), "item_id")

    ahead = F.row_number().over(W.partitionBy("item_id", "kind", "doc").orderBy(F.desc("score"), "chunk"))
    whole = whole.withColumn("later", F.when(F.col("broad") & (F.col("kind") == "protocol") & (ahead == 1), 0).when(F.col("broad"), 1).otherwise(0))
    place = F.row_number().over(W.partitionBy("item_id").orderBy("later", F.desc("score"), "chunk"))
    return whole.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(*columns, "place")


def fused_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of each benchmark item whose id is divisible by 20: documents are the chunks, their sources the documents. Lists:
    the 24 best hits, and the three best that have a digit, lifted by .2."""
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = lasting(hybrid_candidates(documents_index(spark, d), asked).select("item_id", "doc_id", "score"))
    kind = F.when(F.col("source").isin("src0", "src1", "src2", "src3"), "protocol").when(F.startswith("source", F.lit("src1")), "attachment").otherwise("other")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("doc"), kind.alias("kind"), F.col("text").rlike("[0-9]").alias("decides"), F.when(F.length("text") >= 220, 0.04).otherwise(0.0).alias("long"))
    candidates = lasting(found.join(docs, "doc_id").select("item_id", F.col("doc_id").alias("chunk"), "doc", "kind", "score", F.round(F.col("score") + F.col("long"), 6).alias("quality"), "decides"))
    best = lambda rows, n: rows.withColumn("n", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "chunk"))).where(F.col("n") <= n).select("item_id", "chunk", "doc", "kind", "score")
    lifted = best(candidates.where("decides"), 3).withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + 0.2), 6))
    kinds = F.expr("CASE pmod(item_id div 20, 3) WHEN 0 THEN array('protocol', 'attachment') WHEN 1 THEN array('protocol') END")
    return fuse(best(candidates, 24).unionByName(lifted), candidates, asked.select("item_id", kinds.alias("kinds"), F.expr("pmod(item_id div 20, 2) = 0").alias("broad")))


QUERIES = {f.__name__: f for f in (search_modes, fused_retrieval)}
_FOUND = SEARCH_SQL["search_hybrid"]
_FOUND = _FOUND[: _FOUND.rindex("SELECT *, row_number()")].strip()
_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "search_modes": f"""
{_FOUND}, asked AS (SELECT item_id::BIGINT AS item_id, {_NORM.format("text")} AS q, CASE (item_id // 20) % 3 WHEN 0 THEN 'boost' WHEN 1 THEN 'filter' ELSE 'off' END AS mode FROM q UNION ALL SELECT -1, '!!', 'off'),
a AS (SELECT *, CASE mode WHEN 'filter' THEN 'the' ELSE '' END AS own FROM asked),
rest AS (SELECT -1::BIGINT AS item_id, doc_id, 0.72::DOUBLE AS score FROM documents WHERE contains({_NORM.format("text")}, '!!') ORDER BY doc_id LIMIT 100),
f AS (SELECT item_id, doc_id, score FROM s UNION ALL SELECT * FROM rest), l AS (SELECT doc_id, w[1] AS name, 0.9::DOUBLE - (doc_id % 5) / 10::DOUBLE AS confidence, (doc_id % 7) / 7::DOUBLE AS specificity FROM w WHERE len(w) > 0),
x AS (SELECT f.item_id, f.doc_id, f.score, a.mode, a.own, l.confidence, l.specificity, CASE WHEN l.name IS NULL THEN 0 WHEN l.name = y THEN 1 WHEN contains(l.name, y) OR contains(y, l.name) THEN 0.92::DOUBLE
  WHEN list_contains(string_split(y, ' '), l.name) AND len(list_distinct(string_split(y, ' '))) = 1 THEN 0.9::DOUBLE ELSE 0 END AS m FROM f JOIN (SELECT *, CASE WHEN own <> '' THEN own ELSE q END AS y FROM a) a ON a.item_id = f.item_id LEFT JOIN l ON l.doc_id = f.doc_id),
b AS (SELECT *, CASE WHEN mode = 'off' THEN 0 WHEN m > 0 THEN 0.25::DOUBLE * (confidence * m) + 0.1::DOUBLE * specificity ELSE 0 END AS lift FROM x WHERE NOT (mode = 'filter' AND m = 0)),
r AS (SELECT item_id, doc_id, round(least(1, score + lift) + 0.000000001::DOUBLE, 6) AS score, CASE WHEN m > 0 THEN 1 ELSE 0 END AS matches, round(lift + 0.000000001::DOUBLE, 6) AS boost FROM b)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10""",
    "fused_retrieval": f"""
{_FOUND}, c AS (SELECT item_id::BIGINT AS item_id, s.doc_id AS chunk, source AS doc, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'protocol' WHEN starts_with(source, 'src1') THEN 'attachment' ELSE 'other' END AS kind, score,
  round(score + CASE WHEN length(text) >= 220 THEN 0.04::DOUBLE ELSE 0 END, 6) AS quality, regexp_matches(text, '[0-9]') AS decides FROM s JOIN documents d ON d.doc_id = s.doc_id),
a AS (SELECT DISTINCT item_id, CASE (item_id // 20) % 3 WHEN 0 THEN ['protocol', 'attachment'] WHEN 1 THEN ['protocol'] ELSE [] END AS kinds, (item_id // 20) % 2 = 0 AS broad FROM c),
top AS (SELECT item_id, chunk, doc, kind, score FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk) <= 24
  UNION ALL SELECT item_id, chunk, doc, kind, round(least(1, score + 0.2::DOUBLE), 6) FROM (SELECT * FROM c WHERE decides QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk) <= 3)),
h AS (SELECT item_id, chunk, doc, kind, max(score) AS score FROM top JOIN a USING (item_id) WHERE len(kinds) = 0 OR list_contains(kinds, kind) GROUP BY ALL),
lack AS (SELECT item_id, unnest(kinds) AS kind FROM a EXCEPT SELECT item_id, kind FROM h),
chosen AS (SELECT * FROM h UNION ALL SELECT item_id, chunk, doc, kind, score FROM (SELECT c.* FROM c JOIN lack USING (item_id, kind) QUALIFY row_number() OVER (PARTITION BY item_id, kind ORDER BY score DESC, chunk) <= 24)),
p AS (SELECT chosen.*, coalesce(quality, 0) AS quality FROM chosen JOIN a USING (item_id) LEFT JOIN (SELECT item_id, chunk, quality FROM c) USING (item_id, chunk) WHERE broad AND kind = 'protocol'),
d AS (SELECT item_id, doc, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY hi DESC, lo, doc) AS k FROM (SELECT item_id, doc, max(score) AS hi, arg_min(chunk, (-score, chunk)) AS lo FROM p GROUP BY ALL)),
t AS (SELECT item_id, doc FROM d WHERE n > 1 AND k <= 8),
st AS (SELECT item_id, chunk, doc, kind, score FROM (SELECT item_id, chunk, doc, kind, score, quality, 1 AS f FROM c WHERE decides AND kind = 'protocol' UNION ALL SELECT item_id, chunk, doc, kind, score, quality, 0 FROM p) JOIN t USING (item_id, doc)
  QUALIFY row_number() OVER (PARTITION BY item_id, doc ORDER BY f DESC, quality DESC, chunk) = 1),
w2 AS (SELECT * FROM chosen WHERE NOT (kind = 'protocol' AND (item_id, doc) IN (SELECT (item_id, doc) FROM t)) UNION ALL SELECT * FROM st),
o AS (SELECT w2.*, CASE WHEN broad AND kind = 'protocol' AND row_number() OVER (PARTITION BY item_id, kind, doc ORDER BY score DESC, chunk) = 1 THEN 0 WHEN broad THEN 1 ELSE 0 END AS later FROM w2 JOIN a USING (item_id))
SELECT item_id, chunk, doc, kind, score, row_number() OVER (PARTITION BY item_id ORDER BY later, score DESC, chunk) AS place FROM o QUALIFY place <= 8""",
}

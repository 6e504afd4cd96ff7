"""Lexical and vector search, rerank and duplicates of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import cosine, normalized, snippet, tokens
from docmill.operators.index import DOC, PostingIndex, grams_of, index_of, search_index, terms_in
from docmill.operators.texts import NORM, TRIGRAMS
from docmill.sources.tables import table

#: Queries that are broadcast at a time.
BLOCK = 1024


def _numbered(order, *by):
    return F.row_number().over(W.partitionBy("item_id").orderBy(order, *by))


def hybrid_candidates(index: PostingIndex, queries: DataFrame, candidates: int = 250, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item_id, doc_id, score, overlap): the candidates of each query (item_id, text): the best by BM25 over its first 8 tokens, and the
    best by shared trigrams. The score is 0.72 * (1 / (1 + rank by BM25 - 1 over candidates)) plus 0.28 * shared / larger trigram set.

    Queries are taken BLOCK at a time; each shard of the index gives its best candidates, so that what is shuffled hangs on queries and
    shards, not on texts.
    """
    asked = queries.select("item_id", F.array_distinct(F.slice(tokens(F.col("text")), 1, 8)).alias("terms"), normalized(F.col("text")).alias("n"))
    rows = asked.limit(2 * BLOCK + 1).collect()
    if len(rows) > 2 * BLOCK:
        queries = queries.dropDuplicates(["item_id", "text"])
        n = -(-queries.count() // BLOCK)
        parts = [queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]
        return reduce(DataFrame.union, [hybrid_candidates(index, part, candidates, k1, b) for part in parts])
    hits = search_index(index, [(r.item_id, r.terms or [], grams_of(r.n or "")) for r in rows], candidates, k1, b)
    bm25 = hits.where("bm25 IS NOT NULL").select("item_id", "doc_id", F.round("bm25", 6).alias("bm25"))
    bm25 = bm25.withColumn("nth", _numbered(F.desc("bm25"), "doc_id")).where(F.col("nth") <= candidates)
    near = hits.where("bm25 IS NULL").select("item_id", "doc_id", "qn", "cn", "overlap")
    near = near.withColumn("nth3", _numbered(F.desc("overlap"), "doc_id")).where(F.col("nth3") <= candidates)
    both = bm25.select("item_id", "doc_id", "nth").join(near, ["item_id", "doc_id"], "full")
    like = F.coalesce(F.least(F.col("overlap") / F.greatest("qn", "cn"), F.lit(1.0)), F.lit(0.0))
    score = F.round(0.72 * F.coalesce(1 / F.col("nth"), F.lit(0.0)) + 0.28 * like, 6)
    return both.select("item_id", "doc_id", score.alias("score"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def hybrid_search(index: PostingIndex, queries: DataFrame, candidates: int = 250, top: int = 10) -> DataFrame:
    """(item_id, doc_id, rank, score, overlap): the best candidates of each query; ties go to the smaller doc_id."""
    found = hybrid_candidates(index, queries, candidates)
    return found.withColumn("rank", _numbered(F.desc("score"), "doc_id").cast("long")).where(F.col("rank") <= top)


def documents_index(spark: SparkSession, d: str) -> PostingIndex:
    """The lasting index of a folder's documents."""
    return index_of(spark, table(spark, d, "documents"), hashlib.md5(d.encode()).hexdigest())


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents as the index holds them: their version, words and trigrams."""
    return documents_index(spark, d).rows(DOC).select(F.col("id").alias("doc_id"), F.col("key").alias("version"), F.col("size").cast("long").alias("words"), F.col("grams").cast("long").alias("grams"))


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary of the index: in how many documents a term is, and how often."""
    return terms_in(documents_index(spark, d))


def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every benchmark item whose id is divisible by 20."""
    return hybrid_search(documents_index(spark, d), table(spark, d, "benchmark").where("item_id % 20 = 0"))


def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The place of the most usual word of each language in its documents."""
    docs = table(spark, d, "documents")
    words = docs.select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where("length(term) >= 4")
    counts = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("lang").agg(F.min_by("term", F.struct(-F.col("n"), "term")).alias("term"))
    return docs.join(top, "lang").select("doc_id", "term", snippet(F.col("text"), F.col("term")).alias("snippet"))


def nearest(v: DataFrame, q: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k vectors of v (vec_id, embedding) nearest to each of q by cosine, if above 0.

    The queries are broadcast BLOCK at a time; each batch of vectors is normalised once and multiplied with them, and leaves its k
    best for each query (more in a tie). Vectors of another length, null or zero ones match nothing; ties go to the smaller id.
    """
    n = max(1, -(-q.count() // BLOCK))
    parts = []
    for block in range(n):
        rows = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == block).where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").collect()
        by_size: dict[int, list] = {}
        for r in rows:
            by_size.setdefault(len(r.embedding), []).append(r)
        queries = {size: (np.array([r.vec_id for r in rs]), _units(np.array([r.embedding for r in rs], float))) for size, rs in by_size.items() if size}

        def run(batches: Iterator[pa.RecordBatch], queries: dict = queries) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.is_valid(batch.column("embedding")))
                sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
                for size, (query_ids, units) in queries.items():
                    part = batch.filter(pa.array(sizes == size))
                    if not part.num_rows:
                        continue
                    ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                    vectors = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    similarity = np.round(units @ _units(vectors.astype(float)).T, 6)
                    similarity[query_ids[:, None] == ids[None, :]] = -1
                    least = np.partition(similarity, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
                    i, j = np.nonzero((similarity >= least[:, None]) & (similarity > 0))
                    yield pa.record_batch([pa.array(query_ids[i]), pa.array(ids[j]), pa.array(similarity[i, j])], names=["query_id", "vec_id", "similarity"])

        parts.append(v.where("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, similarity double"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", nth.cast("long")).where(F.col("rank") <= k)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of each query (ids divisible by 20), if their cosine is above 0."""
    v = table(spark, d, "embeddings")
    return nearest(v, v.where("vec_id % 20 = 0"))


def vector_rerank(spark: SparkSession, d: str, candidates: int = 10, weight: float = 0.35) -> DataFrame:
    """Twenty hits of each query, the first `candidates` of them by 0.65 of their score and 0.35 of the cosine of document and query
    (0 without vectors), the others unchanged behind them; vectors belong to the documents and items with their ids."""
    hits = hybrid_search(documents_index(spark, d), table(spark, d, "benchmark").where("item_id % 20 = 0"), top=20)
    v = table(spark, d, "embeddings")
    both = hits.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("x")), "doc_id", "left").join(v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("y")), "item_id", "left")
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(F.col("x"), F.col("y")), F.lit(0.0))))
    tail = F.col("rank") > candidates
    out = both.select("item_id", "doc_id", tail.alias("tail"), F.round(F.when(tail, F.col("score")).otherwise((1 - weight) * F.col("score") + weight * near), 6).alias("score"))
    place = F.row_number().over(W.partitionBy("item_id").orderBy("tail", F.desc("score"), "doc_id"))
    return out.select("item_id", "doc_id", "score", place.cast("long").alias("place"))


def centroids(v: DataFrame) -> DataFrame:
    """(label, centroid): the mean vector, by place."""
    place = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return place.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def vector_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids(table(spark, d, "embeddings")).select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


_TOKENS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"
_N, _T = NORM.format("text"), _TOKENS.format(NORM.format("text"))
QUERIES = {f.__name__: f for f in (index_documents, index_terms, search_hybrid, search_snippets, vector_topk, vector_rerank, vector_centroids)}
ORACLE_SQL = {
    "index_documents": f"""
WITH n AS (SELECT doc_id, text, {_N} AS n FROM documents) SELECT doc_id, md5(coalesce(text, chr(0))) AS version, len(regexp_extract_all(n, '[\\p{{L}}\\p{{N}}]+')) AS words, len({TRIGRAMS}) AS grams FROM n""",
    "index_terms": f"""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
    "search_hybrid": f"""
WITH w AS (SELECT doc_id, {_T} AS w FROM documents), tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
q AS (SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0),
wanted AS (SELECT item_id, unnest(list_distinct(({_T})[1:8])) AS term FROM q),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS bm25
       FROM post JOIN df USING (term) JOIN wanted USING (term), tot GROUP BY 1, 2),
bm2 AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY bm25 DESC, doc_id) AS nth FROM bm QUALIFY nth <= 250),
g AS (SELECT doc_id, {TRIGRAMS} AS g FROM (SELECT doc_id, {_N} AS n FROM documents)), qg AS (SELECT item_id, {TRIGRAMS} AS g FROM (SELECT item_id, {_N} AS n FROM q)),
sh AS (SELECT item_id, doc_id, qn, cn, count(*) AS overlap FROM (SELECT doc_id, len(g) AS cn, unnest(g) AS gram FROM g) JOIN (SELECT item_id, len(g) AS qn, unnest(g) AS gram FROM qg) USING (gram) GROUP BY ALL),
sh2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS nth3 FROM sh QUALIFY nth3 <= 250),
s AS (SELECT item_id, doc_id, round(0.72::DOUBLE * coalesce(1 / nth, 0) + 0.28::DOUBLE * coalesce(least(overlap / greatest(qn, cn), 1), 0), 6) AS score, coalesce(overlap, 0) AS overlap FROM bm2 FULL JOIN sh2 USING (item_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "search_snippets": f"""
WITH c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct({_T})) AS term FROM documents) WHERE length(term) >= 4 GROUP BY 1, 2),
t AS (SELECT lang, term FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) = 1),
p AS (SELECT doc_id, text, term, instr(lower(text), lower(term)) AS pos, length(text) AS n FROM documents JOIN t USING (lang)),
s AS (SELECT *, CASE WHEN pos > 0 THEN greatest(pos - 73, 1) ELSE 1 END AS a, least(CASE WHEN pos > 0 THEN pos + 110 ELSE 183 END, n + 1) AS e FROM p)
SELECT doc_id, term, (CASE WHEN a > 1 THEN '...' ELSE '' END) || trim(substr(text, a, e - a)) || (CASE WHEN e <= n THEN '...' ELSE '' END) AS snippet FROM s""",
    "vector_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 6) DESC, v.vec_id) AS rank
FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 AND round(list_cosine_similarity(q.e, v.e), 6) > 0 QUALIFY rank <= 3""",
    "vector_centroids": "SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2",
}
ORACLE_SQL["vector_rerank"] = f"""
WITH h AS ({ORACLE_SQL["search_hybrid"].replace("rank <= 10", "rank <= 20")}), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT h.item_id, h.doc_id, rank > 10 AS tail, round(CASE WHEN rank > 10 THEN score ELSE 0.65::DOUBLE * score + 0.35::DOUBLE * greatest(0, least(1, coalesce(list_cosine_similarity(a.e, b.e), 0))) END, 6) AS score FROM h LEFT JOIN v a ON a.vec_id = h.doc_id LEFT JOIN v b ON b.vec_id = h.item_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY tail, score DESC, doc_id) AS place FROM s"""

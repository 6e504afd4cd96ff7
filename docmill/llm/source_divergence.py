"""How far the sources of a language diverge, term by term: a pair task for each two sources merges their sparse counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import give_back, materialize, text_blocks
from docmill.llm.words import byte_strings

BLOCK = 1 << 20
#: Terms that a task holds before it sends their counts.
HELD = 1 << 21
#: Kept terms of a language for each block of term ids, and sources of a language for each tile: they bound a pair task.
TERMS_PER_BLOCK = 1 << 15
SOURCES_PER_TILE = 16
SCALE, PRIOR = 1_000_000_000, 5
#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]`: letters of ASCII, and every byte of all other characters
IN_TERM = np.zeros(256, bool)
IN_TERM[128:] = IN_TERM[65:91] = IN_TERM[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block and the row of each."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    return byte_strings(LOWER[data[inside]], offsets), np.searchsorted(at, starts, side="right") - 1


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, sources, counts) of parts of docs (lang, source, text): in how many of a part's documents a term is, and its
    occurrences by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        doc_of: list[np.ndarray] = []
        langs: list[pa.Array] = []
        sources: list[pa.Array] = []
        docs_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            coded = pa.chunked_array(held, pa.large_binary()).combine_chunks().dictionary_encode()
            names = coded.dictionary
            code = coded.indices.to_numpy().astype(np.int64)
            lang, source = (pa.concat_arrays(x).dictionary_encode() for x in (langs, sources))
            doc = np.concatenate(doc_of)
            held.clear(), doc_of.clear(), langs.clear(), sources.clear()
            key, n = np.unique(doc << 32 | code, return_counts=True)
            doc, code = key >> 32, key & 0xFFFFFFFF
            of_lang, of_source = lang.indices.to_numpy()[doc], source.indices.to_numpy()[doc]
            order = np.lexsort((of_source, code, of_lang))
            of_lang, of_source, code, n = of_lang[order], of_source[order], code[order], n[order]
            new = np.flatnonzero(np.concatenate(([True], (of_lang[1:] != of_lang[:-1]) | (code[1:] != code[:-1]) | (of_source[1:] != of_source[:-1]))))
            docs_in, counts = np.diff(np.append(new, len(n))), np.add.reduceat(n, new)
            of_lang, of_source, code = of_lang[new], of_source[new], code[new]
            term = np.flatnonzero(np.concatenate(([True], (of_lang[1:] != of_lang[:-1]) | (code[1:] != code[:-1]))))
            docs_in = np.add.reduceat(docs_in, term)
            ends = np.append(term, len(counts))
            for a in range(0, len(term), 1 << 15):
                b = min(a + (1 << 15), len(term))
                inner = slice(ends[a], ends[b])
                offsets = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32))
                yield pa.record_batch(
                    [
                        lang.dictionary.take(pa.array(of_lang[term[a:b]])),
                        names.take(pa.array(code[term[a:b]])).cast(pa.binary()).cast(pa.string()),
                        pa.array(docs_in[a:b].astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, source.dictionary.take(pa.array(of_source[inner]))),
                        pa.ListArray.from_arrays(offsets, pa.array(counts[inner].astype(np.int64))),
                    ],
                    names=["lang", "term", "docs", "sources", "counts"],
                )
            give_back()

        for rows, data, at in text_blocks(batches, BLOCK):
            terms, row = terms_of(data, at)
            held.append(terms)
            doc_of.append(row + docs_held)
            langs.append(rows.column("lang").cast(pa.string()))
            sources.append(rows.column("source").cast(pa.string()))
            docs_held += rows.num_rows
            if sum(map(len, held)) >= HELD or docs_held >= HELD:
                if sum(map(len, held)):
                    yield from flush()
                held.clear(), doc_of.clear(), langs.clear(), sources.clear()
                docs_held = 0
        if sum(map(len, held)):
            yield from flush()

    return docs.mapInArrow(run, "lang string, term string, docs long, sources array<string>, counts array<long>")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), in decimals, since the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.expr("1L") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * terms))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of an array of counts: by long division in three steps of a thousand, each within 64 bits."""
    rest, out, of = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64), total + PRIOR * terms
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest %= of
    return out + 1


def price(a_ids: np.ndarray, a: np.ndarray, a0: int, b_ids: np.ndarray, b: np.ndarray, b0: int) -> tuple[int, int]:
    """The sum of |p - q| over the terms of either side, and how many they are: a term of both is found by a galloping search of the
    shorter list in the longer one, a term of one side is held against the other side's share of an absent term."""
    if len(a_ids) > len(b_ids):
        a_ids, a, a0, b_ids, b, b0 = b_ids, b, b0, a_ids, a, a0
    if not len(b_ids):
        return 0, 0
    at = np.minimum(np.searchsorted(b_ids, a_ids), len(b_ids) - 1)
    both = b_ids[at] == a_ids
    met = at[both]
    value = np.abs(a[both] - b[met]).sum() + np.abs(a[~both] - b0).sum() + np.abs(b - a0).sum() - np.abs(b[met] - a0).sum()
    return int(value), len(a_ids) + len(b_ids) - len(met)


PRICED = "lang string, a string, b string, value long, terms long, a0 long, b0 long, n_terms long"


def _price_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of a pair task: every source of one tile with every source of the other, or each two of one tile."""

    def sparse(t: pa.Table) -> list[tuple]:
        out = []
        for source, nth, total, n_terms, cells in zip(*(t.column(c) for c in ("source", "nth", "total", "n_terms", "cells"))):
            flat = cells.values
            ids, counts = (flat.field(i).to_numpy() if flat is not None else np.zeros(0, np.int64) for i in (0, 1))
            known = n_terms.as_py() > 0
            p = shares(counts, total.as_py(), n_terms.as_py()) if known else counts
            p0 = int(shares(np.zeros(1, np.int64), total.as_py(), n_terms.as_py())[0]) if known else 0
            out.append((source.as_py(), nth.as_py(), ids, p, p0, n_terms.as_py()))
        return out

    rows = []
    if left.num_rows and right.num_rows:
        lang = left.column("lang")[0].as_py()
        others = sparse(right)
        for a, i, a_ids, pa_, a0, n_terms in sparse(left):
            for b, j, b_ids, pb, b0, _ in others:
                if i < j:
                    rows.append((lang, a, b, *price(a_ids, pa_, a0, b_ids, pb, b0), a0, b0, n_terms))
    types = [pa.string()] * 3 + [pa.int64()] * 5
    names = [x.split()[0] for x in PRICED.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from each other one of its language, and its own top terms.

    A language keeps the terms that at least min_docs of its rows have. Null lang, source and text count as ''; rows that repeat a
    doc_id are documents of their own; an empty text has no terms but its group counts; an empty table gives no rows. Ties go to the
    item whose UTF-8 sorts first.

    1. Tasks count terms by (lang, term, source) over long stretches of text; one shuffle by (lang, term) sums them, and what fewer
       than min_docs documents have ends there.
    2. Kept terms get ids inside blocks of about TERMS_PER_BLOCK terms of a language, drawn by hash, so that a (source, block) is a
       sorted array of bounded length.
    3. Pair tasks: the arrays of two tiles of SOURCES_PER_TILE sources are co-grouped, for each block, and each unordered pair is
       priced by a sparse merge; the sums over blocks are completed by the terms that neither side has.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_term = W.partitionBy("lang", "term")
    kept = count_terms(plain).withColumn("of", F.sum("docs").over(by_term)).where(F.col("of") >= min_docs)
    kept = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    kept = kept.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    kept = materialize(kept.withColumn("in_lang", F.sum("n").over(by_term)), "kept-terms")

    vocabulary = kept.select("lang", "term").distinct()
    most = vocabulary.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // TERMS_PER_BLOCK))
    vocabulary = vocabulary.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    vocabulary = vocabulary.withColumn("id", F.row_number().over(W.partitionBy("lang", "block").orderBy("term")).cast("long"))

    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "n_terms"])
    in_lang = W.partitionBy("lang")
    groups = groups.withColumn("nth", F.row_number().over(in_lang.orderBy("source"))).withColumn("lang_total", F.sum("total").over(in_lang))
    groups = groups.withColumn("tile", F.floor((F.col("nth") - 1) / SOURCES_PER_TILE).cast("int"))
    groups = materialize(groups.withColumn("tiles", F.max("tile").over(in_lang) + 1), "groups")

    cells = kept.join(vocabulary, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells"))
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    arrays = materialize(spread.join(cells, ["lang", "source", "block"], "left").withColumn("cells", F.coalesce("cells", F.expr("CAST(array() AS array<struct<id:bigint,n:bigint>>)"))), "sparse-counts")
    columns = ["lang", "block", "lo", "hi", "source", "nth", "total", "n_terms", "cells"]
    left = arrays.withColumn("lo", F.col("tile")).withColumn("hi", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).select(columns)
    right = arrays.withColumn("hi", F.col("tile")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("tile")))).select(columns)
    keys = ["lang", "block", "lo", "hi"]
    priced = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_price_tiles, PRICED)
    priced = priced.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("value", "terms")], *[F.max(c).alias(c) for c in ("a0", "b0", "n_terms")])
    value = F.col("value") + (F.col("n_terms") - F.col("terms")) * F.abs(F.col("a0") - F.col("b0"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]))
    pairs = priced.select("lang", value.alias("value"), ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")

    p = share(F.col("n"), F.col("total"), F.col("n_terms"))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("n_terms"))
    terms = kept.where("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


#: What op13_source_divergence gives, for small tables: every group holds every kept term.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS m, sum(n) OVER (PARTITION BY lang) AS lang_total FROM f),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (m + 5)) // (lang_total + 5 * v) AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""A posting index that lasts: documents in shards, postings in blocks with their maxima, trigrams as bit maps, and a manifest.

A shard is a hash of the doc_id. Its rows (documents, terms, trigrams; sorted by kind and key) are written as one generation of the
shard, and the manifest names the live generation of each. A changed or vanished document makes its shard's next generation, so that
nothing of an old version stays in reach; other shards are left alone. A reader sees the newest complete manifest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import normalized
from docmill.sources.tables import exists, shared_path

#: Postings of a block, and text bytes for each shard at the time of the first build.
POSTINGS, SHARD_BYTES = 128, 1 << 24
MOST_NAMED = 1024
_WORD = regex.compile(r"[\p{L}\p{N}]+")
DOC, TERM, GRAM = "doc", "term", "gram"
#: doc: key is its version, id, size (words; null for a null text), grams; term: size (documents), grams (occurrences), slots, counts and for each block the largest count
#: and the shortest document; gram: a bit for each slot. A slot is a document's place in its shard, by id.
ROW = "part int, kind string, key string, id long, size int, grams int, slots binary, counts binary, most array<int>, least array<int>, bits binary"


def grams_of(n: str) -> set[str]:
    """The character trigrams of a normalised text; a shorter one is its own only one."""
    return {n[i : i + 3] for i in range(len(n) - 2)} if len(n) >= 3 else {n} if n else set()


def _shard_rows(part: int, ids: list, versions: list, texts: list) -> Iterator[tuple]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, versions[i] or "", i))
    sizes = np.zeros(len(order), np.int32)
    terms: dict[str, tuple[list[int], list[int]]] = {}
    grams: dict[str, list[int]] = {}
    for slot, i in enumerate(order):
        text = texts[i]
        words = _WORD.findall(text) if text is not None else []
        sizes[slot] = len(words)
        for w, n in Counter(words).items():
            at, counts = terms.setdefault(w, ([], []))
            at.append(slot)
            counts.append(n)
        held = grams_of(text or "")
        for g in held:
            grams.setdefault(g, []).append(slot)
        yield part, DOC, versions[i], ids[i], None if text is None else len(words), len(held), None, None, None, None, None
    for w in sorted(terms):
        at, counts = (np.array(x, np.int32) for x in terms[w])
        starts = np.arange(0, len(at), POSTINGS)
        yield part, TERM, w, None, len(at), int(counts.sum()), at.tobytes(), counts.tobytes(), np.maximum.reduceat(counts, starts).tolist(), np.minimum.reduceat(sizes[at], starts).tolist(), None
    for g in sorted(grams):
        held = np.zeros(len(order), np.uint8)
        held[grams[g]] = 1
        yield part, GRAM, g, None, len(grams[g]), None, None, None, None, None, np.packbits(held).tobytes()


_TYPES = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
_NAMES = [c.split()[0] for c in ROW.split(", ")]


def _build(docs: pa.Table) -> pa.Table:
    rows = list(_shard_rows(docs.column("part")[0].as_py(), *(docs.column(c).to_pylist() for c in ("id", "version", "n"))))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)


@dataclass
class PostingIndex:
    """The index in the folder `root`; `version` is that of its manifest (0: nothing built yet)."""

    spark: SparkSession
    root: str
    version: int = 0
    _live: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> PostingIndex:
        if not exists(spark, f"{root}/manifest"):
            return cls(spark, root)
        done = spark.read.parquet(f"{root}/manifest").agg(F.max("version")).first()[0]
        return cls(spark, root, done or 0)

    def manifest(self) -> DataFrame:
        """(part, gen, docs, words, texts, parts): the live generation of each shard and its totals."""
        return self.spark.read.parquet(f"{self.root}/manifest").where(F.col("version") == self.version).drop("version")

    def _stored(self) -> DataFrame:
        """The live rows of all kinds. Few live shards are named in the filter, so that only their files are listed; many are joined."""
        if self._live is None:
            stored = self.spark.read.schema(f"{ROW}, gen int").parquet(f"{self.root}/rows")
            shards = self.manifest().select("part", "gen")
            named = shards.limit(MOST_NAMED + 1).collect()
            if len(named) > MOST_NAMED:
                self._live = stored.join(shards, ["part", "gen"])
            else:
                parts: dict[int, list[int]] = {}
                for r in named:
                    parts.setdefault(r.gen, []).append(r.part)
                self._live = stored.where(reduce(lambda x, y: x | y, [(F.col("gen") == g) & F.col("part").isin(x) for g, x in parts.items()], F.lit(False)))
        return self._live

    def rows(self, *kinds: str) -> DataFrame:
        """The live rows of some kinds."""
        return self._stored().where(F.col("kind").isin(*kinds))

    def _named(self, docs: DataFrame, parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
        return docs.select(part.alias("part"), F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce("text", F.lit("\0"))).alias("version"), "text")

    def refresh(self, docs: DataFrame) -> PostingIndex:
        """The index of docs (doc_id, text): shards that hold a new, changed or vanished document get a new generation.

        Versions are compared by their digests, so that only texts of changed shards are read by Python. Rows that repeat a doc_id
        are documents of their own; a null doc_id is one more id. An empty table leaves an index without documents.
        """
        if self.version:
            parts = self.manifest().agg(F.max("parts")).first()[0]
            now = self._named(docs, parts).groupBy("part", "id", "version").agg(F.count(F.lit(1)).alias("n"))
            then = self.rows(DOC).groupBy("part", "id", F.col("key").alias("version")).agg(F.count(F.lit(1)).alias("old"))
            other = now.withColumn("id", F.coalesce("id", F.lit(-(2**63)))).join(then.withColumn("id", F.coalesce("id", F.lit(-(2**63)))), ["part", "id", "version"], "full")
            changed = other.where(~F.col("n").eqNullSafe(F.col("old"))).select("part").distinct()
        else:
            total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
            parts = max(8, -(-total // SHARD_BYTES))
            changed = self.spark.range(parts).select(F.col("id").cast("int").alias("part"))
        gen = self.version + 1
        changed = shared(changed, f"{self.root}/changed/gen={gen}")
        if changed.isEmpty():
            return self
        named = self._named(docs, parts).join(changed, "part").select("part", "id", "version", normalized(F.col("text")).alias("n"))
        built = named.groupBy("part").applyInArrow(_build, ROW)
        built.sortWithinPartitions("part", "kind", "key").write.partitionBy("kind", "part").mode("overwrite").parquet(f"{self.root}/rows/gen={gen}")
        fresh = self.spark.read.schema(f"{ROW}, gen int").option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows/gen={gen}").where(F.col("kind") == DOC)
        fresh = fresh.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("size").alias("texts"))
        fresh = changed.join(fresh, "part", "left").na.fill(0, ["docs", "words", "texts"])
        fresh = fresh.select("part", F.lit(gen).alias("gen"), "docs", "words", "texts", F.lit(parts).alias("parts"))
        if self.version:
            fresh = fresh.unionByName(self.manifest().join(changed, "part", "left_anti"))
        shared(fresh.withColumn("version", F.lit(gen)).coalesce(1), f"{self.root}/manifest", "append")
        return PostingIndex(self.spark, self.root, gen)


def shared(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index_of(spark: SparkSession, docs: DataFrame, name: str) -> PostingIndex:
    """The index of a stored table in the folder that all executors share: built at the first call, and refreshed where the table's
    files are others than those it was built from."""
    root = shared_path(spark, f"index-{name}")
    files = docs.select(F.concat_ws(" ", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("file")).distinct()
    mark = files.agg(F.md5(F.array_join(F.array_sort(F.collect_list("file")), "\n")).alias("mark")).first().mark
    index = PostingIndex.open(spark, root)
    if index.version and exists(spark, f"{root}/built/{mark}-{index.version}"):
        return index
    index = index.refresh(docs)
    shared(spark.range(1), f"{root}/built/{mark}-{index.version}")
    return index


def idf(n: int, df: int) -> float:
    return float(np.log(1 + (n - df + 0.5) / (df + 0.5)))


class Shard:
    """One shard's rows of some terms and trigrams, to be searched."""

    def __init__(self, rows: pa.Table):
        kinds = rows.column("kind").to_numpy()
        docs = rows.filter(pa.array(kinds == DOC))
        order = sorted(range(docs.num_rows), key=lambda i, x=docs.column("id").to_pylist(), y=docs.column("key").to_pylist(): (x[i] is not None, x[i] or 0, y[i] or "", i))
        docs = docs.take(pa.array(order, pa.int64()))
        self.ids = docs.column("id").to_pylist()
        self.sizes = docs.column("size").fill_null(0).to_numpy().astype(float)
        self.n_grams = docs.column("grams").to_numpy()
        self.terms = {r["key"]: r for r in rows.filter(pa.array(kinds == TERM)).select(["key", "slots", "counts", "most", "least"]).to_pylist()}
        grams = rows.filter(pa.array(kinds == GRAM))
        self.grams = dict(zip(grams.column("key").to_pylist(), grams.column("bits").to_pylist()))

    def best(self, terms: dict[str, float], k: int, mean: float, k1: float, b: float, slack: float = 2e-6) -> tuple[np.ndarray, np.ndarray, int]:
        """(slots, scores, postings read): the k best by BM25, and all within `slack` of the last one; terms: idf by term.

        The borders of all blocks divide the slots into intervals; a block's largest count and shortest document bound what it adds to
        any score in it. Intervals are read in order of their bounds, until none can reach the k-th best score.
        """
        lists = []
        for term, weight in terms.items():
            if r := self.terms.get(term):
                at, most, least = np.frombuffer(r["slots"], np.int32), np.array(r["most"]), np.array(r["least"])
                lists.append((at, np.frombuffer(r["counts"], np.int32), at[::POSTINGS], weight * most * (k1 + 1) / (most + k1 * (1 - b + b * least / mean)), weight))
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0), 0
        borders = np.unique(np.concatenate([x[2] for x in lists]))
        bound = np.zeros(len(borders))
        for _, _, first, top, _ in lists:
            block = np.searchsorted(first, borders, side="right") - 1
            bound += np.where(block >= 0, top[block], 0)
        ends = np.append(borders[1:], len(self.ids))
        slots, scores, found, least_score, read = [], [], 0, -np.inf, 0
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < least_score - slack:
                break
            score = np.zeros(ends[i] - borders[i])
            for at, counts, _, _, weight in lists:
                x, y = np.searchsorted(at, (borders[i], ends[i]))
                tf, slot = counts[x:y], at[x:y]
                score[slot - borders[i]] += weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * self.sizes[slot] / mean))
                read += y - x
            hit = np.flatnonzero(score > 0)
            slots.append(hit + borders[i])
            scores.append(score[hit])
            found += len(hit)
            if found >= k:
                so_far = np.concatenate(scores)
                least_score = np.partition(so_far, -k)[-k]
        slots, scores = np.concatenate(slots), np.concatenate(scores)
        keep = scores >= least_score - slack
        return slots[keep], scores[keep], read

    def nearest(self, grams: set[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots, shared trigrams): the k that share most, ties to the first slot."""
        shared_ = np.zeros(len(self.ids), np.int32)
        for g in grams:
            if bits := self.grams.get(g):
                shared_ += np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.ids))
        best = np.argsort(-shared_, kind="stable")[:k]
        best = best[shared_[best] > 0]
        return best, shared_[best]


HITS = "item_id long, doc_id long, bm25 double, overlap long, qn int, cn int"
_HIT_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())


def search_index(index: PostingIndex, asked: list[tuple[int, list[str], set[str]]], candidates: int, k1: float, b: float) -> DataFrame:
    """Hits of a block of queries (item_id, terms, trigrams), from each shard its `candidates` best: rows with bm25, and rows with the
    shared trigrams (overlap) and the sizes of both trigram sets. Only rows of the queries' terms and trigrams leave the scan."""
    totals = index.manifest().agg(F.coalesce(F.sum("docs"), F.lit(0)), F.try_divide(F.sum("words"), F.sum("texts"))).first()
    terms, grams = sorted({t for _, w, _ in asked for t in w}), sorted({g for *_, x in asked for g in x})
    n, mean = totals[0], totals[1] or 1.0
    if terms:  # a row for each of the queries' terms
        weights = {r.key: idf(n, r.df) for r in index.rows(TERM).where(F.col("key").isin(terms)).groupBy("key").agg(F.sum("size").alias("df")).collect()}
    else:
        weights = {}
    rows = index.rows(DOC, TERM, GRAM).where((F.col("kind") == DOC) | (F.col("kind") == TERM) & F.col("key").isin(list(weights)) | (F.col("kind") == GRAM) & F.col("key").isin(grams))

    def search(table: pa.Table) -> pa.Table:
        shard, out = Shard(table), []
        for item, words, trigrams in asked:
            slots, scores, _ = shard.best({w: weights[w] for w in words if w in weights}, candidates, mean, k1, b)
            out += [(item, shard.ids[s], x, None, None, None) for s, x in zip(slots.tolist(), scores.tolist())]
            slots, counts = shard.nearest(trigrams, candidates)
            out += [(item, shard.ids[s], None, x, len(trigrams), int(shard.n_grams[s])) for s, x in zip(slots.tolist(), counts.tolist())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_HIT_TYPES)], names=[c.split()[0] for c in HITS.split(", ")])

    return rows.groupBy("part").applyInArrow(search, HITS)


def terms_in(index: PostingIndex) -> DataFrame:
    """(term, df, occurrences): the index's vocabulary."""
    return index.rows(TERM).groupBy(F.col("key").alias("term")).agg(F.sum("size").alias("df"), F.sum("grams").alias("occurrences"))

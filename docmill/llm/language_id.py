"""Language identification by prediction by partial matching: a byte context tree for each language, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import id_or_lowest, materialize, null_if_lowest, text_blocks, text_or_empty
from docmill.llm.quality_classifier import remainder

#: Bytes of context; a text counts as preceded by so many spaces.
ORDER = 4
PAD = 32
BLOCK = 1 << 20
#: Languages whose trees are broadcast at a time; each has at most (ORDER + 1) * (sample_bytes + longest) strings.
TOGETHER = 16
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """What the trees see of a text: its lower-cased letters, with one space for whatever stands between them, since marks, digits and
    markup tell kinds of texts apart, not languages."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def windows(data: np.ndarray, at: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The ORDER + 1 bytes that end at each place of data[begin:end], the last one on top, so that the upper L bytes are the string
    of length L that ends there; rows start at `at`."""
    out = data[begin:end].astype(np.uint64) << np.uint64(8 * ORDER)
    starts = at[np.searchsorted(at, begin - ORDER) : np.searchsorted(at, end)]
    for j in range(1, ORDER + 1):
        back = np.full(end - begin, PAD, np.uint8)
        lead = max(0, j - begin)
        back[lead:] = data[begin + lead - j : end - j]
        near = (starts[:, None] + np.arange(j)).ravel() - begin  # places with fewer than j bytes of their row before them
        back[near[(near >= 0) & (near < end - begin)]] = PAD
        out |= back.astype(np.uint64) << np.uint64(8 * (ORDER - j))
    return out


def _strings(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(strings, counts) of each length from 1 to ORDER + 1 in a sample of texts."""
    whole, n = np.unique(windows(data, at, 0, len(data)), return_counts=True)
    out = []
    for length in range(1, ORDER + 2):
        key, inverse = np.unique(whole >> np.uint64(8 * (ORDER + 1 - length)), return_inverse=True)
        out.append((key, np.bincount(inverse, n, len(key))))
    return out


def _log2(x: np.ndarray) -> np.ndarray:
    return np.log2(x, out=np.full(x.shape, -np.inf, np.float32), where=x > 0, casting="unsafe")


class Level:
    """The contexts of k bytes of all languages and the strings of k + 1 bytes: a row for each, a column for each language."""

    def __init__(self, k: int, strings: np.ndarray, counts: np.ndarray, below: Level | None):
        self.k, self.strings, self.raw = k, strings, counts
        self.contexts, group = np.unique(strings & np.uint64((1 << 8 * k) - 1), return_inverse=True)
        self.total, self.kinds = (np.zeros((len(self.contexts), counts.shape[1])) for _ in range(2))
        np.add.at(self.total, group, counts)
        np.add.at(self.kinds, group, counts > 0)
        self.here = self.kinds > 0
        self.log_count = _log2(counts)
        self.log_all, self.log_escape = _log2(self.total + self.kinds), _log2(self.kinds)
        if below is not None:
            # after an escape from here, the level below is left with the bytes that never follow this context
            parent = np.searchsorted(below.contexts, self.contexts >> np.uint64(8))
            same = np.searchsorted(below.strings, strings >> np.uint64(8))
            excluded = np.zeros_like(self.total)
            np.add.at(excluded, group, np.where(counts > 0, below.raw[same], 0))
            kinds = below.kinds[parent] - self.kinds
            self.below_all, self.below_escape = _log2(below.total[parent] - excluded + kinds), _log2(kinds)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


@dataclass
class ContextTrees:
    """The trees of some languages. Escapes are those of method C (as many as there are distinct bytes after the context), and a
    byte that a longer context has is excluded in the shorter ones, so that the code lengths are those of a proper code."""

    languages: list[str]
    levels: list[Level]

    @classmethod
    def of(cls, languages: list[str], tables: list[list[tuple[np.ndarray, np.ndarray]]]) -> ContextTrees:
        levels: list[Level] = []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([t[k][0] for t in tables]))
            counts = np.zeros((len(keys), len(tables)))
            for j, t in enumerate(tables):
                counts[np.searchsorted(keys, t[k][0]), j] = t[k][1]
            levels.append(Level(k, keys, counts, levels[-1] if levels else None))
        for level in levels:
            level.raw = level.total = level.kinds = None
        return cls(languages, levels)

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each window, a column for each language."""
        shape = len(wanted), len(self.languages)
        out = np.zeros(shape)
        open_ = np.ones(shape, bool)
        before: Level | None = None
        came = np.zeros(len(wanted), np.int64)
        from_before = np.zeros(shape, bool)  # an escape from the level above led here
        context = wanted & np.uint64((1 << 8 * ORDER) - 1)
        for level in reversed(self.levels):
            k = level.k
            c, known = Level.find(level.contexts, context >> np.uint64(8 * (ORDER - k)))
            s, seen = Level.find(level.strings, wanted >> np.uint64(8 * (ORDER - k)))
            here = open_ & known[:, None] & level.here[c]
            weight, escape = level.log_all[c], level.log_escape[c]
            if before is not None:
                weight = np.where(from_before, before.below_all[came], weight)
                escape = np.where(from_before, before.below_escape[came], escape)
            count = np.where(seen[:, None], level.log_count[s], -np.inf)
            hit = here & (count > -np.inf)
            miss = here & ~hit & (escape > -np.inf)  # where nothing new is left, the escape is certain and free
            with np.errstate(invalid="ignore"):
                out += np.where(hit, weight - count, 0) + np.where(miss, weight - escape, 0)
            open_ &= ~hit
            from_before, came, before = here & ~hit, c, level
        unseen = 256 - (self.levels[0].log_count > -np.inf).sum(axis=0)
        return out + open_ * np.log2(np.maximum(unseen, 1))

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code length of each row of a block in bits, a column for each language; a block of places at a time."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        for begin in range(0, len(data), BLOCK):
            end = min(begin + BLOCK, len(data))
            distinct, place = np.unique(windows(data, at, begin, end), return_inverse=True)
            bits = self.bits(distinct)
            row = np.searchsorted(at, np.arange(begin, end), side="right") - 1
            for j in range(len(self.languages)):
                out[:, j] += np.bincount(row, bits[place, j], len(out))
        return out


def sample_by_language(docs: DataFrame, sample_bytes: int, longest: int) -> DataFrame:
    """(lang, text): for each language the whole texts of up to `longest` bytes with the least hashes of doc_id, until the next one
    would pass sample_bytes. Null languages and empty texts teach nothing; of several texts of a doc_id the least counts."""
    usable = docs.where(F.col("lang").isNotNull() & F.octet_length("text").between(1, longest))
    place = F.pmod(F.xxhash64("id"), F.lit(2**52)) / F.lit(float(2**52))
    rows = usable.select(F.col("lang").cast("string").alias("lang"), id_or_lowest().alias("id"), "text").withColumn("place", place)
    sizes = rows.select("lang", "id", "place", F.octet_length("text").cast("long").alias("n")).groupBy("lang", "id", "place").agg(F.max("n").alias("n"))
    # a first cut by hash, so that the ordered sum sees a bounded group: about twice what is wanted passes
    whole = sizes.groupBy("lang").agg(F.sum("n").alias("all"))
    sizes = sizes.join(whole, "lang").where(F.col("place") < (2.0 * sample_bytes + 16.0 * longest) / F.col("all"))
    so_far = F.sum("n").over(W.partitionBy("lang").orderBy("place", "id").rowsBetween(W.unboundedPreceding, 0))
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") - F.col("n") < sample_bytes)
    # a row for each language: texts up to its last place are the sample, so that no text is shuffled to find it
    limits = materialize(chosen.groupBy("lang").agg(F.max("place").alias("limit")), "sample-limits")
    rows = rows.join(limits, "lang").where("place <= limit")
    return rows.groupBy("lang", "id").agg(F.min(letters(F.col("text"))).alias("text")).select("lang", "text")


def fit_trees(docs: DataFrame, sample_bytes: int = 1 << 20, longest: int = 1 << 16) -> DataFrame:
    """(lang, strings, counts): a tree for each language, each built in a task of its own from its bounded sample, and written."""

    def build(texts: pd.DataFrame) -> pd.DataFrame:
        parts = [t.encode() for t in sorted(texts["text"])]
        data = np.frombuffer(b"".join(parts), np.uint8)
        tables = _strings(data, np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
        return pd.DataFrame({"lang": [texts["lang"].iloc[0]], "strings": [[k.tobytes() for k, _ in tables]], "counts": [[n.astype(np.int64).tobytes() for _, n in tables]]})

    trees = sample_by_language(docs, sample_bytes, longest).groupBy("lang").applyInPandas(build, "lang string, strings array<binary>, counts array<binary>")
    return materialize(trees, "context-trees")


def identify_languages(docs: DataFrame, trees: DataFrame, temper: float = 0.1) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of docs: the language in whose code the whole text is shortest.

    Ties go to the language that sorts first. The score is that language's share of 2 ** -(temper * bits) over all languages:
    bits of neighbouring bytes aren't independent, so that an untempered share would always be 0 or 1. A null text and one without a
    letter get `und` and a score of 0, and so does every text where no language was learned. A text is read in blocks,
    whatever its length; languages are broadcast TOGETHER at a time and each pass keeps the best so far.
    """
    fields = "doc_id long, text string, best string, bits double, sum double"
    state = docs.select(
        id_or_lowest().alias("doc_id"),
        F.when(F.col("text").rlike(r"\p{L}"), letters(F.col("text"))).alias("text"),
        F.lit(None).cast("string").alias("best"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("sum"),
    )
    names = [r.lang for r in trees.select("lang").orderBy("lang").toLocalIterator()]
    for first in range(0, len(names), TOGETHER):
        part = names[first : first + TOGETHER]
        rows = {r.lang: r for r in trees.where(F.col("lang").isin(part)).collect()}  # bounded by TOGETHER and the sample
        tables = [[(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)) for k, n in zip(rows[x].strings, rows[x].counts)] for x in part]
        shared = docs.sparkSession.sparkContext.broadcast(ContextTrees.of(part, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for rows, data, at in text_blocks(batches, BLOCK):
                bits = model.lengths(data, at)
                old, total = rows.column("bits").to_numpy(), rows.column("sum").to_numpy()
                pick = bits.argmin(axis=1)
                best = bits[np.arange(len(bits)), pick]
                low = np.minimum(old, best)
                total = total * np.exp2(temper * np.where(np.isinf(old), 0, low - old)) + np.exp2(temper * (low[:, None] - bits)).sum(axis=1)
                named = [model.languages[p] if b < o else n for p, b, o, n in zip(pick.tolist(), best.tolist(), old.tolist(), rows.column("best").to_pylist())]
                yield pa.record_batch([rows.column("doc_id"), rows.column("text"), pa.array(named, pa.string()), pa.array(low), pa.array(total)], names=["doc_id", "text", "best", "bits", "sum"])

        state = state.mapInArrow(run, fields)
        if first + TOGETHER < len(names):
            state = materialize(state, "languages-so-far")
    found = F.col("text").isNotNull() & F.col("best").isNotNull()
    return state.select(
        null_if_lowest(F.col("doc_id")).alias("doc_id"),
        F.when(found, F.col("best")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(found, 1 / F.col("sum")).otherwise(F.lit(0.0)).alias("score"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(4) == 2
    found = identify_languages(docs, fit_trees(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

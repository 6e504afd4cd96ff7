"""Modified Kneser-Ney n-grams over all code points, fitted by Spark joins in two halves; each half's texts get the other's model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import give_back, materialize

ORDER = 5
PAD = " " * (ORDER - 1)  # before each text
PLACE = 12  # bits of a symbol in a packed n-gram of one stretch of text
STRETCH = 1 << 22
SLICE = 1 << 19


def fold() -> Column:
    """The half of a text, 0 or 1: by its hash, so that exact copies share one."""
    return F.expr("cast(xxhash64(text) & 1 as int)")


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts, each after its PAD; where each PAD starts; which points are of texts."""
    points = np.frombuffer("".join(PAD + t for t in texts).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *(len(t) + len(PAD) for t in texts[:-1])])
    own = np.ones(len(points), bool)
    for k in range(len(PAD)):
        own[starts + k] = False
    return points, starts, own


def distinct(points: np.ndarray, own: np.ndarray, folds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams as rows of code points, fold, n) of the stretches of a stream. A stretch is halved while it has more symbols than
    PLACE bits can number, so the packed numbers are exact."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    symbols = np.flatnonzero(seen)
    if len(points) > STRETCH or len(symbols) > 1 << PLACE:
        half = len(points) // 2
        for part in (slice(0, half), slice(half - ORDER + 1, None)):
            yield from distinct(points[part], own[part], folds[part])
        return
    rank = np.zeros(0x110000, np.uint16)
    rank[symbols] = np.arange(len(symbols))
    ranks = rank[points]
    n = len(points) - ORDER + 1
    packed = np.zeros(n, np.int64)
    for k in range(ORDER):
        packed <<= PLACE
        packed |= ranks[k : k + n]
    packed = np.sort((packed << 1 | folds[ORDER - 1 :])[own[ORDER - 1 :]])
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else np.zeros(0, np.int64)
    some = packed[first]
    grams = np.stack([symbols[some >> 1 + PLACE * (ORDER - 1 - k) & (1 << PLACE) - 1] for k in range(ORDER)], axis=1)
    yield grams.astype(np.uint32), some & 1, np.diff(np.append(first, len(packed)))


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1): how often each n-gram of ORDER code points ends in the texts (lang, text, fold) of either half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[str, int]]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, rows in held.items():
                texts, halves = [t for t, _ in rows], [h for _, h in rows]
                points, starts, own = stream(texts)
                folds = np.repeat(np.array(halves, np.int64), np.diff(np.append(starts, len(points))))
                for grams, half, n in distinct(points, own, folds):
                    letters = grams.tobytes().decode("utf-32-le")
                    column = pa.array([letters[i : i + ORDER] for i in range(0, len(letters), ORDER)], pa.string())
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), column, pa.array(np.where(half == 0, n, 0)), pa.array(np.where(half == 1, n, 0))], names=["lang", "gram", "n0", "n1"])
            held.clear()
            give_back()

        size = 0
        for batch in batches:
            for lang, text, half in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("fold").to_pylist()):
                held.setdefault(lang, []).append((got := text.as_py(), half))
                size += len(got)
                if size > STRETCH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("lang", "text", "fold").mapInArrow(run, "lang string, gram string, n0 long, n1 long").groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _discounts(orders: list[DataFrame]) -> DataFrame:
    """For each language and order (lang, k): the discounts a{half}1 to a{half}3 of a count of 1, 2, and 3 or more."""
    of = lambda h, j: F.sum(F.when(F.col(f"n{h}") == j, 1).otherwise(0)).cast("double")
    every = reduce(DataFrame.union, [grams.select("lang", F.lit(ORDER - i).alias("k"), "n0", "n1") for i, grams in enumerate(orders)])
    kinds = every.groupBy("lang", "k").agg(*(of(h, j).alias(f"k{h}{j}") for h in (0, 1) for j in (1, 2, 3, 4)))
    columns = []
    for h in (0, 1):
        k = {j: F.col(f"k{h}{j}") for j in (1, 2, 3, 4)}
        y = F.when(k[1] > 0, k[1] / (k[1] + 2 * k[2])).otherwise(0.5)
        for j in (1, 2, 3):
            d = F.when(k[j] > 0, j - (j + 1) * y * k[j + 1] / k[j]).otherwise(0.5 * j)
            columns.append(F.least(F.greatest(d, F.lit(0.05 * j)), F.lit(0.95 * j)).alias(f"a{h}{j}"))
    return materialize(kinds.select("lang", "k", *columns), "discounts")


def fit(counts: DataFrame) -> DataFrame:
    """(lang, gram, log0, log1): the log10 probability of each n-gram's last letter after the others by the model of either half.

    Lower orders count the different n-grams that end so (Chen and Goodman 1998); the lowest is even over the language's letters.
    An n-gram that a half lacks has its model's probability too. A window has at most as many rows as the language has letters.
    """
    orders = [materialize(counts, "grams")]
    for k in range(ORDER - 1, 0, -1):
        ends = F.substring("gram", 2, k).alias("gram")
        seen = [F.sum((F.col(f"n{h}") > 0).cast("long")).alias(f"n{h}") for h in (0, 1)]
        orders.append(materialize(orders[-1].groupBy("lang", ends).agg(*seen), "grams"))
    discounts = _discounts(orders)
    lower = orders[-1].groupBy("lang").agg((1 / F.count("*")).alias("p0")).select("lang", F.lit("").alias("ends"), "p0", F.col("p0").alias("p1"))
    same = Window.partitionBy("lang", "context")
    for k, grams in enumerate(reversed(orders), 1):
        grams = grams.withColumns({"context": F.substring("gram", 1, k - 1), "ends": F.substring("gram", 2, k - 1)})
        sums = {}
        for h in (0, 1):
            n = F.col(f"n{h}")
            sums |= {f"t{h}": F.sum(n).over(same)}
            sums |= {f"w{h}{j}": F.sum(is_j.cast("long")).over(same) for j, is_j in ((1, n == 1), (2, n == 2), (3, n > 2))}
        own = F.broadcast(discounts.where(F.col("k") == k).drop("k"))  # a row for each language
        grams = grams.withColumns(sums).join(own, "lang").join(F.broadcast(lower) if k == 1 else lower, ["lang", "ends"])
        found = []
        for h in (0, 1):
            n, t = F.col(f"n{h}"), F.col(f"t{h}")
            d = F.when(n == 0, 0.0).when(n == 1, F.col(f"a{h}1")).when(n == 2, F.col(f"a{h}2")).otherwise(F.col(f"a{h}3"))
            weight = reduce(Column.__add__, [F.col(f"w{h}{j}") * F.col(f"a{h}{j}") for j in (1, 2, 3)]) / t
            found.append(F.when(t == 0, F.col(f"p{h}")).otherwise((n - d) / t + weight * F.col(f"p{h}")).alias(f"p{h}"))
        lower = grams.select("lang", F.col("gram").alias("ends"), *found)
    return materialize(lower.select("lang", F.col("ends").alias("gram"), F.log10("p0").cast("float").alias("log0"), F.log10("p1").cast("float").alias("log1")), "letters")


def keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each code point but the first ORDER - 1."""
    n = len(points) - ORDER + 1
    h = np.zeros(n, np.uint64)
    for k in range(ORDER):
        h ^= points[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Letters:
    """n-grams of a language by their hashes, sorted, and the log10 probabilities by the model of either half."""

    hashes: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, grams: list[str], logs: np.ndarray) -> Letters:
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
        hashes = keys(points)[::ORDER]
        at = np.argsort(hashes)
        return cls(np.append(hashes[at], np.uint64(2**64 - 1)), np.vstack([logs[at], np.zeros((1, 2), np.float32)]))

    @cached_property
    def buckets(self) -> tuple[np.uint64, np.ndarray]:
        """How far to shift a hash for its bucket's number, and where each bucket starts."""
        bits = max(len(self.hashes).bit_length(), 1)
        return np.uint64(64 - bits), np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)

    def of_points(self, points: np.ndarray, half: int) -> np.ndarray:
        """The log10 probability of each code point but the first ORDER - 1, by the model of a half; 0 where the n-gram isn't here."""
        wanted = keys(points)
        shift, starts = self.buckets
        at = starts[wanted >> shift]
        todo = np.flatnonzero(self.hashes[at] < wanted)
        while len(todo):
            at[todo] += 1
            todo = todo[self.hashes[at[todo]] < wanted[todo]]
        return np.where(self.hashes[at] == wanted, self.logs[at, half], np.float32(0))


def ranges(table: DataFrame, held: int) -> Iterator[dict[str, Letters]]:
    """The n-grams of all languages, in ranges of about `held` of them by hash; each n-gram is in one."""
    n = max(-(-table.count() // held), 1)
    for k in range(n):
        got = table.where(F.pmod(F.xxhash64("gram"), F.lit(n)) == k).toArrow()
        found = {}
        for lang in pc.unique(got["lang"]).to_pylist():
            own = got.filter(pc.equal(got["lang"], lang))
            found[lang] = Letters.of(own["gram"].to_pylist(), np.stack([own["log0"].to_numpy(), own["log1"].to_numpy()], axis=1))
        yield found


def sums(models: dict[str, Letters], batch: pa.RecordBatch) -> np.ndarray:
    """For each row (lang, text, fold): the sum of its letters' log10 probabilities by the other half's model, of the n-grams held."""
    groups: dict[tuple[str, int], list[list[int]]] = {}
    sizes: dict[tuple[str, int], int] = {}
    texts = batch.column("text").to_pylist()
    for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist())):
        if key not in groups or sizes[key] > 1 << 21:
            groups.setdefault(key, []).append([])
            sizes[key] = 0
        groups[key][-1].append(i)
        sizes[key] += len(texts[i])
    out = np.zeros(len(texts))
    for (lang, half), parts in groups.items():
        if lang not in models:
            continue
        for rows in parts:
            points, starts, own = stream([texts[i] for i in rows])
            logs = np.zeros(len(points))
            for a in range(ORDER - 1, len(points), SLICE):
                logs[a : a + SLICE] = models[lang].of_points(points[a - ORDER + 1 : a + SLICE], 1 - half)
            out[rows] = np.add.reduceat(logs * own, starts)
    return out

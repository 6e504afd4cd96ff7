"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import narrowed, null_if_lowest
from docmill.llm.hashing import mixed

SLOT_BITS = 22


def normalised(text: str) -> str:
    """Lower-cased, white space collapsed and stripped."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q code points from each place on."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n]
    return mixed(h)


def best_alignment(item: np.ndarray, region: np.ndarray, budget: int, shift: int) -> tuple[int, int, int] | None:
    """The least number of edits, at most budget, that turns a stretch of region into item: (edits, start, end), or None.

    Only cells within `budget` of the diagonals 0 to `shift` are computed: row i holds the region's places i - budget to
    i + shift + budget. Ties: the earliest end, then the latest start.
    """
    m, width = len(item), shift + 2 * budget + 1
    far = 1 << 20
    padded = np.concatenate([np.full(budget, -1, np.int64), region.astype(np.int64), np.full(m + width, -1, np.int64)])
    slots = np.arange(width, dtype=np.int64)
    place = slots - budget  # region characters before the cell, in row 0
    scale = 1 << 32  # a cell: edits * scale + (scale / 2 - start), so that the minimum settles the start too
    cost = np.where((place >= 0) & (place <= len(region)), scale // 2 - place, far * scale)
    for i in range(1, m + 1):
        same = padded[i - 1 : i - 1 + width] == item[i - 1]
        step = cost + np.where(same, 0, scale)
        step[:-1] = np.minimum(step[:-1], cost[1:] + scale)
        at = slots - budget + i
        step[(at < 0) | (at > len(region))] = far * scale
        cost = np.minimum.accumulate(step - slots * scale) + slots * scale
        cost[(at < 0) | (at > len(region))] = far * scale
    end = int(np.argmin((cost >> 32) * (2 * width) + slots))
    edits = int(cost[end] >> 32)
    if edits > budget:
        return None
    return edits, scale // 2 - int(cost[end] & (scale - 1)), end - budget + m


class Items:
    """One block of benchmark items, indexed by q-grams of at most `q` code points.

    An edit destroys g of an item's m - g + 1 g-grams at most, so that m - g + 1 - g * e are left after e edits. An item whose
    budget leaves no 8-gram is indexed by the longest g-grams of which one is left: g = m // (e + 1).
    """

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        by_gram: dict[int, list[tuple[int, str]]] = {}
        for i, t in items:
            if t := normalised(t or ""):
                by_gram.setdefault(min(q, len(t) // (int(rate * len(t)) + 1)), []).append((i, t))
        self.indexes = [Index(part, g, rate) for g, part in sorted(by_gram.items())]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of the best match of each item in the normalised text; ties: the first."""
        points = code_points(text)
        return sorted(m for index in self.indexes for m in index.matches(text, points))


class Index:
    """Items that are indexed by grams of one length."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q = q
        self.items = [(i, t, code_points(t)) for i, t in items]
        n = [len(p) for _, _, p in self.items]
        self.budget = [int(rate * m) for m in n]
        self.needed = [m - q + 1 - q * e for m, e in zip(n, self.budget)]
        hashes = [grams(p, q) for _, _, p in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.of_item = np.repeat(np.arange(len(n)), [len(h) for h in hashes])[order] if n else np.zeros(0, np.int64)
        self.of_place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if n else np.zeros(0, np.int64)
        self.slots = np.zeros(1 << SLOT_BITS, np.uint8)
        self.slots[(flat >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = 1
        self.reach = max((m - q + 1 + e for m, e in zip(n, self.budget)), default=1)  # places that a match spans at most

    def matches(self, text: str, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        hashes = grams(points, self.q)
        if not len(hashes):
            return []
        hit = self.slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        best: dict[int, tuple[int, int, int]] = {}
        self._in_region(text, points, hashes, hit, 0, len(hashes), best)
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]

    def _in_region(self, text: str, points: np.ndarray, hashes: np.ndarray, hit: np.ndarray, low: int, high: int, best: dict) -> None:
        """Counts shared q-grams of each item in overlapping bands of diagonals, and aligns the bands that meet the budget."""
        places = low + np.flatnonzero(hit[low:high])
        first = np.searchsorted(self.hashes, hashes[places], side="left")
        many = np.searchsorted(self.hashes, hashes[places], side="right") - first
        if int(many.sum()) > 1 << 21 and high - low > 4 * self.reach:
            # too many pairs at once: the same by halves, which overlap by what a match can span
            mid = (low + high) // 2
            self._in_region(text, points, hashes, hit, low, mid + self.reach, best)
            self._in_region(text, points, hashes, hit, mid - self.reach, high, best)
        else:
            self._bands(text, points, places, first, many, best)

    def _bands(self, text: str, points: np.ndarray, places: np.ndarray, first: np.ndarray, many: np.ndarray, best: dict) -> None:
        n = int(many.sum())
        if not n:
            return
        entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(n)
        item = self.of_item[entry]
        diagonal = np.repeat(places, many) - self.of_place[entry]
        budget, needed = np.array(self.budget), np.array(self.needed)
        # a match's diagonals span at most e: bands of 2(e + 1) diagonals, begun at each e + 1, hold it whole
        step = budget[item] + 1
        band = diagonal // step
        both_item, both_band = np.concatenate([item, item]), np.concatenate([band, band - 1])
        key = both_item * (1 << 40) + both_band + (1 << 39)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        last = np.append(first[1:], n * 2)
        wanted = needed[both_item[order[first]]]
        for i in np.flatnonzero(last - first >= wanted).tolist():
            group = order[first[i] : last[i]]
            if len(np.unique(self.of_place[entry[group % n]])) < wanted[i]:  # the same few q-grams again and again
                continue
            k, b = int(both_item[group[0]]), int(both_band[group[0]])
            e, (_, whole, pattern) = self.budget[k], self.items[k]
            start = max(0, b * (e + 1) - e)
            shift = max(0, (b + 2) * (e + 1) - 1 + e - start)
            end = start + len(pattern) + shift + e
            if (found := text.find(whole, start, end)) >= 0:
                got = 0, found - start, found - start + len(pattern)
            else:
                got = best_alignment(pattern, points[start:end], e, shift)
            if got is not None:
                new = (got[0], start + got[1], start + got[2])
                best[k] = min(best.get(k, new), new)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of characters at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield sorted({(r.item_id, r.text) for r in part.collect()})


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, q: int = 8, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, edits, start, end): each document and benchmark item that a stretch of its text matches with at most
    rate * (item length) edits; the best such stretch (fewest edits, then the first), by code points of the normalised text.

    Both sides are lower-cased and their white space is collapsed. A text with at most e edits of an item of m code points shares
    m - q + 1 - q * e of the item's q-grams with it inside a band of e + 1 diagonals; where m is so short that none would be left,
    shorter grams are taken, so that every item has its whole budget (below ten code points: none, the item itself is sought).
    Items without text match nothing; null or empty texts match nothing. Items with equal texts are each reported. The items are a stated query set, taken against all rows in blocks of about block_chars.
    """
    out = None
    for block in _blocks(benchmark, block_chars):

        def run(batches: Iterator[pa.RecordBatch], block: list[tuple[int, str]] = block) -> Iterator[pa.RecordBatch]:
            items = Items(block, q, rate)
            for batch in batches:
                texts = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                rows = [(i, *m) for i, t in texts for m in items.matches(normalised(t))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "edits", "start", "end"])

        found = narrowed(docs).mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")
        out = found if out is None else out.union(found)
    return out.distinct().withColumn("doc_id", null_if_lowest(F.col("doc_id")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that match an item, all columns kept."""
    found = find_contamination(docs, benchmark, **options).select(F.col("doc_id").alias("_contaminated_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_contaminated_id"]), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

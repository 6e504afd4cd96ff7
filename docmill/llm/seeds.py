"""Seeds of repeats: which of them occur again anywhere in the table, as a filter of bounded size; and known whole copies."""

from __future__ import annotations

import hashlib
import zlib

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import text_blocks

#: The upper bits of a seed name its bucket; a row of the shuffle holds many seeds of one bucket.
BUCKET_BITS = 16


def buckets_for(docs: DataFrame) -> int:
    """log2 of a number of buckets, one for each stretch of 2 MB of text or so, of which a task compares one at a time."""
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return min(24, max(6, (text_bytes >> 21).bit_length()))


def parts_of_hot(left: int, parts: int = 4) -> list[tuple[int, int]]:
    """Ranges of how many bytes before its suffix a string begins, which divide the strings around a hot beginning."""
    cuts = [left * k // parts for k in range(parts)] + [left + 1]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Repeats; runs of strings of one document that overlap or adjoin here become one."""
    full = n > 0
    doc, start, end = doc[full].astype(np.int64), start[full].astype(np.int64), (start + n)[full].astype(np.int64)
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        new = np.concatenate(([True], doc[1:] != doc[:-1]))
        # the furthest end so far in the document: ends of each document are lifted above those of the one before
        lift = (np.cumsum(new) - 1) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + lift) - lift
        new[1:] |= start[1:] > reach[:-1]
        first = np.flatnonzero(new)
        doc, start, end = doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]
    return pa.record_batch([pa.array(x) for x in (doc, start, end - start)], names=["doc_id", "start", "n"])


@dataclass
class Loaded:
    bits: np.ndarray
    often: np.ndarray
    log2: int

    def has(self, seeds: np.ndarray) -> np.ndarray:
        slot = seeds >> np.uint64(64 - self.log2)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def hot(self, seeds: np.ndarray) -> np.ndarray:
        """often: a byte for each eight ranges, zlib-compressed on the way since nearly all are 0."""
        slot = seeds >> np.uint64(64 - self.log2)
        return (self.often[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


@dataclass
class SeedFilter:
    """A broadcast bit for each of 2**log2 ranges of seeds: set if a seed in it occurs twice or more; and one for very often."""

    shared: Broadcast
    log2: int

    def load(self) -> Loaded:
        bits, often = self.shared.value
        return Loaded(np.frombuffer(bits, np.uint8), np.frombuffer(zlib.decompress(often), np.uint8), self.log2)


#: From so many marks on a seed counts as hot. A block marks it once or twice, and again for each 64 places there, so that one which
#: isn't hot stands in fewer than 64 * HOT places.
HOT = 2048


def known_copies(docs: DataFrame, least_bytes: int, most: int = 1 << 17) -> Broadcast:
    """MD5 of a text -> the smallest doc_id that has it, of the `most` texts whose copies hold the most bytes.

    A copy under a larger doc_id repeats that document throughout, so that it need not be searched; a text that isn't among
    these is searched like any other, with the same result. The map takes 40 bytes a text, whatever the input.
    """
    named = docs.select("doc_id", F.octet_length("text").alias("n"), F.unhex(F.md5("text")).alias("md5")).where(F.col("n") >= least_bytes)
    groups = named.groupBy("md5").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")).where("copies > 1")
    rows = groups.orderBy(F.desc(F.col("copies") * F.col("n")), "md5").limit(most).select("md5", "first").collect()
    return docs.sparkSession.sparkContext.broadcast({bytes(r.md5): r.first for r in rows})


def copies_in(copies: dict[bytes, int], doc_ids: np.ndarray, data: np.ndarray, at: np.ndarray, least_bytes: int) -> np.ndarray:
    """Which rows of a block are copies of a document with a smaller doc_id."""
    if not copies:
        return np.zeros(len(doc_ids), bool)
    text = memoryview(data)
    long = np.diff(at) >= least_bytes
    return np.array([bool(l) and copies.get(hashlib.md5(text[a:b]).digest(), i) < i for l, a, b, i in zip(long, at[:-1].tolist(), at[1:].tolist(), doc_ids.tolist())], bool)


def repeated_seeds(docs: DataFrame, of_block: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], most_bits: int, block: int) -> SeedFilter:
    """Finds the seeds that occur twice or more in the texts of docs.

    of_block: the seeds of a block (rows, bytes, offsets), one for each place. Each task sends the distinct seeds of its blocks,
    those that occur twice in one block two times (and one time more for each 64), six bytes each and bucketed by their upper bits; a reducer sorts a bucket's
    seeds and returns a bit map of the repeated ones, and one of the hot ones. The maps have 2**most_bits bits: their size is
    bounded by that parameter, not by the data. A bit stands for a range of seeds, so the filter may let seeds
    through that occur once; it never stops one that occurs twice.
    """
    log2 = most_bits
    low = 64 - BUCKET_BITS - 48  # bits that are left out on the way
    width = 1 << (log2 - BUCKET_BITS - 3)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            seeds, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seeds = np.repeat(seeds, np.minimum(counts, 2) + counts // 64)
            bucket = (seeds >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            six = ((seeds >> np.uint64(low)) & np.uint64((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            at = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1))
            full = [k for k in range(1 << BUCKET_BITS) if at[k] < at[k + 1]]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array([six[6 * at[k] : 6 * at[k + 1]] for k in full], pa.binary())], names=["bucket", "seeds"])

        for rows, data, at in text_blocks(batches, block):
            held.append(of_block(rows, data, at))
            if sum(map(len, held)) >= 1 << 21:
                yield out()
        if held:
            yield out()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def out(bucket: int) -> pa.RecordBatch:
            six = np.frombuffer(b"".join(held.pop(bucket)), np.uint8).reshape(-1, 6)
            eight = np.zeros((len(six), 8), np.uint8)
            eight[:, :6] = six
            seeds = np.sort(eight.view("<u8").ravel())
            maps = []
            for n in (2, HOT):
                bits = np.zeros(width * 8, np.uint8)
                again = seeds[n - 1 :][seeds[n - 1 :] == seeds[: max(0, len(seeds) - n + 1)]]
                bits[(again >> np.uint64(48 - (log2 - BUCKET_BITS))).astype(np.int64)] = 1
                maps.append(pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()))
            return pa.record_batch([pa.array([bucket], pa.int32()), *maps], names=["bucket", "bits", "often"])

        for batch in batches:
            for bucket, seeds in zip(batch.column("bucket").to_pylist(), batch.column("seeds").to_pylist()):
                if held and bucket not in held:
                    yield out(next(iter(held)))
                held.setdefault(bucket, []).append(seeds)
        if held:
            yield out(next(iter(held)))

    rows = docs.mapInArrow(sent, "bucket int, seeds binary").repartition(F.col("bucket")).sortWithinPartitions("bucket")
    maps = rows.mapInArrow(repeated, "bucket int, bits binary, often binary").collect()  # twice 2**most_bits bits at most
    whole = np.zeros((2, 1 << BUCKET_BITS, width), np.uint8)
    for r in maps:
        whole[0, r.bucket], whole[1, r.bucket] = np.frombuffer(r.bits, np.uint8), np.frombuffer(r.often, np.uint8)
    return SeedFilter(docs.sparkSession.sparkContext.broadcast((whole[0].tobytes(), zlib.compress(whole[1].tobytes(), 1))), log2)

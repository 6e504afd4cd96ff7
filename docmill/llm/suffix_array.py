"""Suffix-array deduplication of byte strings: the intervals of common prefixes of a sampled, enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import narrowed, null_if_lowest, text_blocks
from docmill.llm.hashing import Spans, mixed, sliding_min
from docmill.llm.seeds import buckets_for, copies_in, known_copies, parts_of_hot, repeated_seeds, runs

#: Text bytes that a task works on at a time, and suffixes that it sorts at a time.
BLOCK, SUFFIXES = 1 << 21, 1 << 15
#: Stands for what lies outside the document: no byte of UTF-8.
OUTSIDE = 0xFF


def lcp_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each common-prefix interval of an enhanced suffix array with a depth of at least `least`.

    lcp[i]: the common prefix of suffixes i - 1 and i; lcp[0] is not read. One scan with a stack: an interval is pushed where
    the common prefix grows and is complete where it falls below its depth.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = lcp[i] if i < len(lcp) else least - 1, i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(context: np.ndarray, left: int, length: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The maximal repeat groups, of at least `length` bytes, around suffixes that begin at column `left` of context (a row for each
    suffix, `left` bytes before it and `length` from it on): (group, row, left bytes, right bytes), a line for each occurrence.

    Sorts the suffixes and scans their common prefixes into intervals, none of which can be extended to the right as a whole. An
    interval's members are sorted by the bytes before them, read backwards, and the same scan divides them into groups that can't
    be extended to the left: the next bytes there differ, a document begins, or the context ends. Such a group is a maximal
    repeat if it can't be extended to the right either. All its occurrences belong to it, not just neighbours. Yields several chunks; groups are numbered inside a chunk.
    """
    right = np.ascontiguousarray(context[:, left:])
    order = np.argsort(right.view(f"S{length}").ravel(), kind="stable")
    context, right = context[order], right[order]
    ends = right == OUTSIDE
    most = np.where(ends.any(axis=1), ends.argmax(axis=1), length)
    differs = right[1:] != right[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    lcp = np.minimum(lcp, np.minimum(most[1:], most[:-1]))
    found = np.array(list(lcp_intervals([0, *lcp.tolist()], least)), np.int64).reshape(-1, 3)
    if not len(found):
        return
    # the same to the left: the rank of each suffix by the bytes before it, read backwards
    before = np.ascontiguousarray(context[:, :left][:, ::-1])
    outside = before == OUTSIDE
    room = np.where(outside.any(axis=1), outside.argmax(axis=1), left)
    rank = np.empty(len(context), np.int64)
    rank[np.argsort(before.view(f"S{left}").ravel(), kind="stable")] = np.arange(len(context))
    depth, first, last = found.T
    members = last - first + 1
    work = np.cumsum(members)
    at = 0
    while at < len(found):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + (1 << 18), side="right")))
        # a line for each interval and member, an interval's members by their rank
        interval = np.repeat(np.arange(at, end), members[at:end])
        row = np.arange(len(interval)) - np.repeat(np.cumsum(members[at:end]) - members[at:end], members[at:end]) + first[interval]
        row = row[np.lexsort((rank[row], interval))]
        same = before[row[1:]] == before[row[:-1]]
        common = np.where(same.all(axis=1), left, same.argmin(axis=1))
        common = np.minimum(common, np.minimum(room[row[1:]], room[row[:-1]]))
        # a repeat has `length` bytes: what the right side lacks has to be on the left
        low = np.maximum(0, length - depth)[interval]
        over = np.where(interval[1:] == interval[:-1], common - low[1:], -1)
        divided = np.array(list(lcp_intervals([-1, *over.tolist()], 0)), np.int64).reshape(-1, 3)
        at = end
        if not len(divided):
            continue
        shared, start, stop = divided.T
        sizes = stop - start + 1
        group = np.repeat(np.arange(len(divided)), sizes)
        line = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[group]
        member, after = row[line], depth[interval[line]]
        # all members go on alike to the right: a longer repeat has them
        beyond = np.where(after < length, right[member, np.minimum(after, length - 1)], OUTSIDE)
        begins = np.cumsum(sizes) - sizes
        high = np.maximum.reduceat(beyond, begins)
        maximal = (high == OUTSIDE) | (high != np.minimum.reduceat(beyond, begins))
        take = maximal[group]
        if take.any():
            yield (np.cumsum(maximal) - 1)[group][take], order[member[take]], (shared + low[start])[group][take], after[take]


def _context(data: np.ndarray, begin: np.ndarray, end: np.ndarray, places: np.ndarray, left: int, length: int) -> np.ndarray:
    """The bytes around places, OUTSIDE beyond their document's begin and end."""
    padded = np.full(len(data) + left + length, OUTSIDE, np.uint8)
    padded[left : left + len(data)] = data
    out = np.lib.stride_tricks.sliding_window_view(padded, left + length)[places]
    near = np.flatnonzero((places - begin < left) | (end - places < length))
    index = places[near, None] + np.arange(-left, length)
    out[near] = np.where((index >= begin[near, None]) & (index < end[near, None]), out[near], np.uint8(OUTSIDE))
    return out


def _extents(context: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of the document each context has before its suffix and from it on."""
    outside = context == OUTSIDE
    before, after = outside[:, :left][:, ::-1], outside[:, left:]
    return np.where(before.any(axis=1), before.argmax(axis=1), left), np.where(after.any(axis=1), after.argmax(axis=1), context.shape[1] - left)


def _keys(context: np.ndarray, left: int) -> np.ndarray:
    """Contexts as strings that sort by the suffix and then by the bytes before it, read backwards."""
    return np.ascontiguousarray(np.concatenate([context[:, left:], context[:, :left][:, ::-1]], axis=1)).view(f"S{context.shape[1]}").ravel()


def collapsed(doc: np.ndarray, context: np.ndarray, left: int, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with wholly equal contexts (and equal seeds), those of the smallest document, and all the others.

    The others are repeats for as far as the context goes; the first ones stand for the context in what follows.
    """
    key = _keys(context, left)
    order = np.argsort(key, kind="stable") if seed is None else np.lexsort((key, seed))
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    if seed is not None:
        new[1:] |= seed[order][1:] != seed[order][:-1]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(doc[order], first)
    later = doc[order] > low[np.cumsum(new) - 1]
    return order[~later], order[later]


class Places:
    """The sampled suffixes of a block: where the least hash of `gram` bytes stands in some window of `length` bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, gram: int):
        width = length - gram + 1
        spans = Spans(data)
        grams = spans.rolling(gram)
        seeds = sliding_min(grams, width)
        begins = np.arange(len(seeds))
        over = np.zeros(len(data) + 1, np.int32)  # windows that cross an offset belong to no document
        inner = at[1:-1]
        np.add.at(over, np.maximum(inner - length + 1, 0), 1)
        np.add.at(over, inner, -1)
        inside = begins[np.cumsum(over)[: len(seeds)] == 0]
        self.spans = spans
        around = np.zeros(len(grams) + width - 1, np.uint64)
        if len(inside):
            around[inside + width - 1] = seeds[inside]
        self.places = np.flatnonzero((~sliding_min(~around, width) == grams) & (grams != 0)) if len(inside) else np.zeros(0, np.int64)
        # least hashes are small numbers: mixed again, they fill all buckets alike
        self.seeds = mixed(grams[self.places])


COLUMNS = "key long, kind int, doc_id long, start long, n int, context binary"
REPEAT, SUFFIX = 0, 1


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(doc)
    columns = [key.view(np.int64), np.full(size, kind, np.int32), doc.astype(np.int64), start.astype(np.int64), np.ones(size, np.int32) if n is None else n.astype(np.int32)]
    return pa.record_batch([*map(pa.array, columns), pa.nulls(size, pa.binary())], names=["key", "kind", "doc_id", "start", "n", "context"])


def packed_suffixes(bucket_bits: int, seed: np.ndarray, doc: np.ndarray, start: np.ndarray, context: np.ndarray) -> pa.RecordBatch:
    """Suffixes as one row for each bucket (the upper bits of their seeds), compressed: arrays of seed, doc_id and start, and the contexts."""
    order = np.argsort(seed, kind="stable")
    bucket = (seed[order] >> np.uint64(64 - bucket_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    squeeze = zstandard.ZstdCompressor(level=3).compress
    blobs = []
    for a, b in zip(first, np.append(first[1:], len(order))):
        i = order[a:b]
        # numbers by their bytes' places, so that high bytes, mostly zero, stand together
        numbers = np.stack([seed[i].view(np.int64), doc[i], start[i]]).astype("<i8").view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1)
        blobs.append(squeeze(np.ascontiguousarray(numbers).tobytes() + context[i].tobytes()))
    n, size = np.diff(np.append(first, len(order))), len(first)
    columns = [bucket[first], np.full(size, SUFFIX, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64), n.astype(np.int32)]
    return pa.record_batch([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=["key", "kind", "doc_id", "start", "n", "context"])


def unpacked(blob: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seeds, doc_ids, starts, contexts) of a row of packed_suffixes."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    numbers = np.ascontiguousarray(data[: 24 * n].reshape(3, 8, n).transpose(0, 2, 1)).view("<i8").reshape(3, n)
    return numbers[0].view(np.uint64), numbers[1], numbers[2], data[24 * n :].reshape(n, width)


def repeated_strings(docs: DataFrame, length: int, gram: int, filter_bits: int) -> DataFrame:
    """(doc_id, start, n): runs of starts of `length`-byte strings that also start in a smaller doc_id."""
    left = length - gram
    copies = known_copies(docs, length)

    def of_block(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        _, data, at, _ = _split(copies, rows, data, at, length)
        return Places(data, at, length, gram).seeds

    seeds = repeated_seeds(docs, of_block, filter_bits, BLOCK)
    bucket_bits = buckets_for(docs)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seeds.load()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """Among equal contexts, those of the smallest document here may be the first of all; the others are repeats."""
            key, doc, start, context = (np.concatenate(x) for x in zip(*held))
            held.clear()
            if not len(doc):
                return
            first, later = collapsed(doc, context, left, key)
            yield _some(*_whole(doc[later], start[later], context[later], left, length))
            yield packed_suffixes(bucket_bits, key[first], doc[first], start[first], context[first])

        for rows, data, at in text_blocks(batches, BLOCK):
            ids, data, at, gone = _split(copies, rows, data, at, length)
            if len(gone[0]):
                yield _some(gone[0], np.zeros(len(gone[0]), np.int64), gone[1])
            p = Places(data, at, length, gram)
            keep = known.has(p.seeds)
            places, key = p.places[keep], p.seeds[keep]
            row = np.searchsorted(at, places, side="right") - 1
            begin, end = at[row], at[row + 1]
            context = _context(data, begin, end, places, left, length)
            hot = known.hot(key)
            for low, high in parts_of_hot(left) if hot.any() else ():
                i = np.flatnonzero(hot & (begin <= places - low) & (places + length - high <= end))
                part = context[i]
                part[:, : left - high] = OUTSIDE
                part[:, left + length - low :] = OUTSIDE
                held.append((mixed(p.spans.of(places[i] - low, places[i] + length - high) + np.uint64(low)), ids[row[i]], (places - begin)[i], part))
            i = np.flatnonzero(~hot)
            held.append((key[i], ids[row[i]], (places - begin)[i], context[i]))
            if sum(len(h[0]) for h in held) >= 1 << 16:
                yield from flush()
        if held:
            yield from flush()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (kind, key)."""
        held: list[tuple[np.ndarray, ...]] = []  # the suffixes of one bucket
        bucket = -1

        def suffixes() -> Iterator[pa.RecordBatch]:
            """Sorts the suffixes of the bucket, whole seeds at a time."""
            seed, doc, start, context = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(seed, kind="stable")
            seed = seed[order]
            a = 0
            while a < len(order):
                b = int(np.searchsorted(seed, seed[min(a + SUFFIXES, len(seed)) - 1], side="right"))
                i = order[a:b]
                yield from repeats(seed[a:b], doc[i], start[i], context[i])
                a = b

        def repeats(seed: np.ndarray, doc: np.ndarray, start: np.ndarray, context: np.ndarray) -> Iterator[pa.RecordBatch]:
            first, later = collapsed(doc, context, left, seed)
            yield runs(*_whole(doc[later], start[later], context[later], left, length))
            # a seed that is left with one suffix has no other repeat
            seed = seed[first]
            again = np.zeros(len(seed), bool)
            again[1:] = seed[1:] == seed[:-1]
            again[:-1] |= again[1:]
            i = first[again]
            if not len(i):
                return
            doc, start, context = doc[i], start[i], context[i]
            for group, row, before, after in maximal_repeats(context, left, length, gram):
                new = np.concatenate(([True], group[1:] != group[:-1]))
                low = np.minimum.reduceat(doc[row], np.flatnonzero(new))
                late = doc[row] > low[group]
                r, n = row[late], before[late] - np.maximum(0, length - after[late]) + 1
                yield runs(doc[r], start[r] - before[late], n)

        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            repeat = batch.slice(0, int((kind == REPEAT).sum()))
            if repeat.num_rows:
                yield runs(*(repeat.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "n")))
            suffix = batch.slice(repeat.num_rows)
            for key, n, blob in zip(*(suffix.column(c).to_pylist() for c in ("key", "n", "context"))):
                if held and key != bucket:
                    yield from suffixes()
                bucket = key
                held.append(unpacked(blob, n, left + length))
        if held:
            yield from suffixes()

    rows = docs.mapInArrow(sampled, COLUMNS).repartition("key").sortWithinPartitions("kind", "key")
    return rows.mapInArrow(compared, "doc_id long, start long, n long")


def _whole(doc: np.ndarray, start: np.ndarray, context: np.ndarray, left: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, start, n): all strings of contexts."""
    before, after = _extents(context, left)
    return doc, start - before, before - np.maximum(0, length - after) + 1


def _some(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Repeats, dealt by a hash of their place."""
    doc, start, n = (c.to_numpy() for c in runs(doc, start, n).columns)
    return _rows(REPEAT, mixed(doc.view(np.uint64) ^ mixed(start.view(np.uint64))), doc, start, n)


def _split(copies: Broadcast, rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, length: int) -> tuple:
    """A block's doc_ids, and its bytes and offsets with known copies emptied; (doc_ids, strings) of these copies."""
    ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
    copy, sizes = copies_in(copies.value, ids, data, at, length), np.diff(at)
    gone = ids[copy], sizes[copy] - length + 1
    if copy.any():
        data, at = data[np.repeat(~copy, sizes)], np.concatenate(([0], np.cumsum(np.where(copy, 0, sizes))))
    return ids, data, at, gone


def drop_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 24, filter_bits: int = 28) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans), a row for each row of docs.

    A text's UTF-8 bytes (null: empty) are kept but for each byte that a string of `length` bytes covers which also starts in a
    document with a smaller doc_id. Overlaps count, and strings are judged on the input. n_spans counts the maximal removed
    runs. Repeats inside one document stay. A null doc_id is the smallest. Rows that repeat a doc_id are one document: neither is
    before the other, and each loses the same bytes.

    1. Whole copies of a text under a larger doc_id are repeats throughout; those that weigh most are known beforehand.
    2. Sampled suffixes: in every string of `length` bytes, the one that begins with its least-hashed `gram` bytes. Those whose
       first `gram` bytes stand nowhere else are left out by a filter of bounded size; the others are dealt by them, with the
       bytes around, so that each task has the whole of some ranges of the suffix array.
    3. There the suffixes are sorted, common prefixes scanned into intervals, and these divided by their left bytes into maximal
       repeats (maximal_repeats); all occurrences outside a group's smallest document are removed.
    4. Beginnings that stand in very many places (seeds.HOT) would make one range unbounded: their suffixes are dealt by further
       bytes, in four parts by how far before the suffix a string may begin, each with the bytes that all its strings share as
       beginning and without the bytes that none of them reaches. What then has a whole equal context is sent once a block.
    """
    docs = narrowed(docs)
    found = repeated_strings(docs, length, gram, filter_bits).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = docs.join(found, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, counts in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("counts")):
                data = text.encode()
                if starts.as_py() is None:
                    rows.append((data, len(data), 0, 0))
                    continue
                covered = np.zeros(len(data) + 1, np.int32)
                starts, ends = starts.values.to_numpy(), starts.values.to_numpy() + counts.values.to_numpy() + length - 1
                fits = ends <= len(data)  # a repeated doc_id may have a shorter text
                np.add.at(covered, starts[fits], 1)
                np.add.at(covered, ends[fits], -1)
                gone = np.cumsum(covered)[:-1] > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                rows.append((np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), spans))
            if rows:
                kept, *counts = zip(*rows)
                yield pa.record_batch([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    out = joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.withColumn("doc_id", null_if_lowest(F.col("doc_id")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, pos, substr(h, 2 * pos::BIGINT + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS pos FROM d)),
first AS (SELECT w, min(doc_id) AS doc FROM win GROUP BY w HAVING count(*) > 1),
rep AS (SELECT win.doc_id, win.pos FROM win JOIN first ON win.w = first.w AND win.doc_id > first.doc),
b AS (SELECT doc_id, pos, substr(h, 2 * pos::BIGINT + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS pos FROM d)),
marked AS (
  SELECT b.doc_id, b.pos, b.x, count(r.pos) OVER (PARTITION BY b.doc_id ORDER BY b.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM b LEFT JOIN rep r ON b.doc_id = r.doc_id AND b.pos = r.pos),
run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked),
agg AS (
  SELECT doc_id, count(*)::BIGINT AS n_bytes, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, count(*) FILTER (WHERE opens)::BIGINT AS n_spans,
         sha256(unhex(coalesce(string_agg(x, '' ORDER BY pos) FILTER (WHERE NOT gone), ''))) AS kept_sha256
  FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""

"""Substring deduplication: documents joined on winnowed anchors, matches extended both ways, maximal repeats removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import narrowed, null_if_lowest, text_blocks
from docmill.llm.hashing import Spans, mixed, sliding_min
from docmill.llm.seeds import buckets_for, parts_of_hot, repeated_seeds, runs
from docmill.llm.words import Words, byte_strings

#: Text bytes that a task works on at a time (its arrays take about 60 times that), and occurrences that it compares at a time.
BLOCK, OCCURRENCES = 1 << 20, 1 << 15


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Anchors:
    """The winnowed anchors of a block: in each window of `window` words, the place of the least hash of seed_words words.

    So equal windows have equal anchors at equal places, and neighbouring windows mostly the same one.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, seed_words: int):
        self.words = Words(data, at)
        first = self.words.first
        self.spans = Spans(self.words.hashes())
        grams = self.spans.rolling(seed_words)
        width = window - seed_words + 1
        least = sliding_min(grams, width)
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        inside = np.flatnonzero(row[: len(least)] == row[window - 1 :]) if len(least) else np.zeros(0, np.int64)
        around = np.zeros(len(grams) + width - 1, np.uint64)
        if len(inside):
            around[inside + width - 1] = least[inside]
        self.places = np.flatnonzero((~sliding_min(~around, width) == grams) & (grams != 0)) if len(inside) else np.zeros(0, np.int64)
        self.row = row[self.places]
        # least hashes are small numbers: mixed again, they fill all buckets alike
        self.seeds = mixed(grams[self.places])
        self.left, self.right = self.places - first[self.row], first[self.row + 1] - self.places

    def contexts(self, which: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[bytes]:
        """The words from `left` before to `right` after the beginning of the anchors."""
        at, text, places = self.words.at, memoryview(self.words.text), self.places[which]
        return [bytes(text[a:b]) for a, b in zip(at[places - left].tolist(), at[places + right].tolist())]


def earliest(doc: np.ndarray, place: np.ndarray, left: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences with wholly equal contexts the earliest one, and those that come after it."""
    order = np.lexsort((place, doc))
    codes = pa.array([contexts[i] for i in order.tolist()], pa.large_binary()).dictionary_encode().indices.to_numpy()
    _, at, group = np.unique(codes.astype(np.int64) << 8 | left[order], return_index=True, return_inverse=True)
    low = order[at][group]
    later = (doc[order] != doc[low]) | (place[order] != place[low])
    return order[at], order[later]


def extended(key: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(doc_id, window start): the repeats among occurrences of anchors, which are joined by their keys.

    All matches of an anchor are extended at once, word by word to the right and then to the left: occurrences that agree so
    far form a class, the next word divides it, and one that is alone is done. A window that begins `a` words before the anchor
    matches where both its sides are in one class, and is a repeat wherever it isn't the earliest. Words are compared as such.
    """
    most = int(left.max(initial=0))
    total = left + right
    data = np.frombuffer(b"".join(contexts), np.uint8)
    words = byte_strings(data, np.concatenate(([0], np.flatnonzero(data == 32) + 1))).dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(key)), total)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    table = np.full((window + most, len(key)), -1, np.int64)
    table[most - left[row] + nth, row] = words
    size = int(words.max(initial=0)) + 1

    def divided(classes: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(classes), -1, np.int64)
        live = np.flatnonzero((classes >= 0) & (word >= 0))
        _, new, count = np.unique(classes[live] * size + word[live], return_inverse=True, return_counts=True)
        out[live] = np.where(count[new] > 1, new, -1)
        return out

    rights = [np.unique(key, return_inverse=True)[1].astype(np.int64)]
    for k in range(window):
        rights.append(divided(rights[-1], table[most + k]))
    lefts = rights[0]
    for a in range(min(most, window) + 1):
        if a:
            lefts = divided(lefts, table[most - a])
        live = np.flatnonzero((lefts >= 0) & (rights[window - a] >= 0))
        both = lefts[live] * len(key) + rights[window - a][live]
        order = np.lexsort((place[live], doc[live], both))
        live, both = live[order], both[order]
        new = np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]
        low = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = live[(doc[live] != doc[low]) | (place[live] != place[low])]
        yield doc[later], place[later] - a


COLUMNS = "key long, kind int, doc_id long, start long, n int, occurrences binary"
REPEAT, OCCURRENCE = 0, 1
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _repeats(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Repeats, dealt by a hash of their place."""
    doc, start, n = (c.to_numpy() for c in runs(doc, start, n).columns)
    key = mixed(doc.view(np.uint64) ^ mixed(start.view(np.uint64))).view(np.int64)
    return pa.record_batch([*map(pa.array, (key, np.full(len(doc), REPEAT, np.int32), doc, start, n.astype(np.int32))), pa.nulls(len(doc), pa.binary())], names=NAMES)


def packed(bucket_bits: int, key: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes]) -> pa.RecordBatch:
    """Occurrences as one row for each bucket (the upper bits of their keys), compressed: arrays of numbers, and the contexts."""
    order = np.argsort(key, kind="stable")
    bucket = (key[order] >> np.uint64(64 - bucket_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(order) else order
    squeeze = zstandard.ZstdCompressor(level=3).compress
    blobs = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        i = order[a:b]
        numbers = np.stack([key[i].view(np.int64), doc[i], place[i], left[i], right[i]]).astype("<i8").view(np.uint8).reshape(5, -1, 8).transpose(0, 2, 1)
        blobs.append(squeeze(np.ascontiguousarray(numbers).tobytes() + b"".join([contexts[j] for j in i.tolist()])))
    n, size = np.diff(np.append(first, len(order))), len(first)
    columns = [bucket[first], np.full(size, OCCURRENCE, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64), n.astype(np.int32)]
    return pa.record_batch([*map(pa.array, columns), pa.array(blobs, pa.binary())], names=NAMES)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(keys, doc_ids, places, left, right, contexts) of a row of packed."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    numbers = np.ascontiguousarray(np.frombuffer(data, np.uint8, 40 * n).reshape(5, 8, n).transpose(0, 2, 1)).view("<i8").reshape(5, n)
    text = data[40 * n :]
    ends = np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1))
    cuts = ends[np.concatenate(([0], np.cumsum(numbers[3] + numbers[4])))].tolist()
    return numbers[0].view(np.uint64), *numbers[1:], [text[a:b] for a, b in zip(cuts, cuts[1:])]


def repeated_windows(docs: DataFrame, window: int, seed_words: int, filter_bits: int) -> DataFrame:
    """(doc_id, start, n): runs of windows whose words also start earlier."""
    reach = window - seed_words
    seeds = repeated_seeds(docs, lambda rows, data, at: Anchors(data, at, window, seed_words).seeds, filter_bits, BLOCK)
    bucket_bits = buckets_for(docs)

    def whole(doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return doc, place - left, left - np.maximum(0, window - right) + 1

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seeds.load()
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """Of equal contexts only the earliest here may be the first of all; the others are repeats."""
            key, doc, place, left, right = (np.concatenate(x) for x in zip(*(h[:5] for h in held)))
            contexts = [c for h in held for c in h[5]]
            held.clear()
            first, later = earliest(doc, place, left, contexts)
            yield _repeats(*whole(doc[later], place[later], left[later], right[later]))
            yield packed(bucket_bits, key[first], doc[first], place[first], left[first], right[first], [contexts[i] for i in first.tolist()])

        for rows, data, at in text_blocks(batches, BLOCK):
            anchors = Anchors(data, at, window, seed_words)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = known.has(anchors.seeds)
            hot = known.hot(anchors.seeds)
            for low, high in [(0, reach), *(parts_of_hot(reach) if (keep & hot).any() else ())]:
                some = keep & ~hot if (low, high) == (0, reach) else keep & hot & (anchors.left >= low) & (anchors.right >= window - high)
                i = np.flatnonzero(some)
                if not len(i):
                    continue
                left, right, place = np.minimum(anchors.left[i], high), np.minimum(anchors.right[i], window - low), anchors.places[i]
                key = anchors.seeds[i] if (low, high) == (0, reach) else mixed(anchors.spans.of(place - low, place + window - high) + np.uint64(low))
                held.append((key, ids[anchors.row[i]], anchors.left[i], left, right, anchors.contexts(i, left, right)))
            if sum(len(h[0]) for h in held) >= 1 << 15:
                yield from flush()
        if held:
            yield from flush()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (kind, key)."""
        held: list[tuple] = []  # the occurrences of one bucket
        bucket = -1

        def bucketful() -> Iterator[pa.RecordBatch]:
            """Extends the matches of the bucket, whole anchors at a time."""
            columns, contexts = [np.concatenate(x) for x in zip(*(h[:5] for h in held))], [c for h in held for c in h[5]]
            held.clear()
            order = np.argsort(columns[0], kind="stable")
            a = 0
            while a < len(order):
                key = columns[0][order]
                b = int(np.searchsorted(key, key[min(a + OCCURRENCES, len(key)) - 1], side="right"))
                i = order[a:b]
                yield from matches(*(c[i] for c in columns), [contexts[j] for j in i.tolist()])
                a = b

        def matches(key: np.ndarray, doc: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes]) -> Iterator[pa.RecordBatch]:
            first, later = earliest(doc, place, left, contexts)
            yield runs(*whole(doc[later], place[later], left[later], right[later]))
            # an anchor that is left with one context has no other match
            _, group, count = np.unique(key[first], return_inverse=True, return_counts=True)
            i = first[count[group] > 1]
            if len(i):
                found = list(extended(key[i], doc[i], place[i], left[i], right[i], [contexts[j] for j in i.tolist()], window))
                d, s = (np.concatenate(x) for x in zip(*found))
                yield runs(d, s, np.ones(len(d), np.int64))

        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            repeat = batch.slice(0, int((kind == REPEAT).sum()))
            if repeat.num_rows:
                yield runs(*(repeat.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "n")))
            for key, n, blob in zip(*(batch.slice(repeat.num_rows).column(c).to_pylist() for c in ("key", "n", "occurrences"))):
                if held and key != bucket:
                    yield from bucketful()
                bucket = key
                held.append(unpacked(blob, n))
        if held:
            yield from bucketful()

    rows = docs.mapInArrow(anchored, COLUMNS).repartition("key").sortWithinPartitions("kind", "key")
    return rows.mapInArrow(compared, "doc_id long, start long, n long")


def drop_repeated_words(docs: DataFrame, window: int = 20, seed_words: int = 5, filter_bits: int = 27) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, spans), a row for each row of docs.

    The words `[^\\x20\\x09-\\x0D]+` of a text are kept but for each word that a window of `window` words covers whose words also
    start earlier, in a smaller doc_id or further up in the same document; kept words are joined by one space. spans lists the
    maximal repeats that went: (first word, number of words). Texts of fewer words lose nothing; null is an empty text. A null
    doc_id is the smallest. Rows that repeat a doc_id are copies of one document: they lose the same words, and neither counts as
    the earlier.

    1. Anchors: in every window, the least hash of its seed_words-word sequences. Anchors found once cannot stand for a repeat.
       Those found again go into a filter of 2**filter_bits bits, so that what is broadcast is bounded; where it fills up, more
       anchors are joined below, with the same result.
    2. Join: occurrences of anchors that pass are dealt by anchor, with the words that a window around them can reach. In a task's
       block only the earliest of equal contexts is sent: the others are repeats at once. Very frequent anchors (seeds.HOT) are
       dealt by further words, in four parts by how far before the anchor a window may begin.
    3. Extension: matches of an anchor are extended both ways on their words (`extended`); windows that come after their first
       occurrence are repeats. Overlapping and adjoining ones are one maximal repeat. No result hangs on a hash alone.
    """
    docs = narrowed(docs)
    found = repeated_windows(docs, window, seed_words, filter_bits)
    spans = found.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    joined = docs.join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "counts"))):
                words = text.encode().split()
                if not starts:
                    rows.append((b" ".join(words).decode(), len(words), 0, []))
                    continue
                covered = np.zeros(len(words) + 1, np.int32)
                starts, counts = np.array(starts), np.array(counts)
                fits = starts + counts + window - 1 <= len(words)
                np.add.at(covered, starts[fits], 1)
                np.add.at(covered, (starts + counts + window - 1)[fits], -1)
                gone = np.cumsum(covered)[:-1] > 0
                a, b = _runs(gone)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((kept.decode(), len(words), int(gone.sum()), [{"start": int(x), "words": int(y - x)} for x, y in zip(a, b)]))
            if rows:
                kept, n, removed, spans = zip(*rows)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
                yield pa.record_batch([batch.column("doc_id"), pa.array(kept), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind)], names=["doc_id", "kept_text", "n_words", "n_removed", "spans"])

    out = joined.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long, spans array<struct<start:long,words:long>>")
    return out.withColumn("doc_id", null_if_lowest(F.col("doc_id")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, pos, word FROM (
    SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents))),
win AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER s AS h, count(*) OVER s AS n
  FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
rep AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY sha256(h) ORDER BY doc_id, pos) AS k FROM win WHERE n = 20) WHERE k > 1),
marked AS (
  SELECT w.doc_id, w.pos, w.word, count(r.pos) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN rep r ON w.doc_id = r.doc_id AND w.pos = r.pos),
agg AS (
  SELECT doc_id, count(*)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""

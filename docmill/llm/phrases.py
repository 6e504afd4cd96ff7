"""Phrase collocations: n-grams of word ids counted losslessly in counting quotient filters that are merged across shards."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import give_back, materialize, text_blocks
from docmill.llm.hashing import mixed
from docmill.llm.words import byte_strings

BLOCK = 1 << 20
#: Words of one language in a coded stretch, and n-grams that a task sorts into a filter at a time.
STRETCH, HELD = 1 << 20, 1 << 21
#: Word ids are dealt in so many buckets of the words' hashes.
ID_BUCKETS = 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_GAP = IS_BREAK.copy()
IS_GAP[list(b" \t")] = True
ROUNDS = [np.uint64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a block, the row of each, and whether a piece begins with it."""
    data = LOWER[data]
    inside = ~IS_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))) + 1
    words = byte_strings(data[inside], np.concatenate(([0], np.cumsum(ends - starts))))
    row = np.searchsorted(at, starts, side="right") - 1
    first = np.ones(len(starts), bool)
    if len(starts):
        breaks = np.concatenate(([0], np.cumsum(IS_BREAK[data])))
        first[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (row[1:] != row[:-1])
    return words, row, first


def code_stretches(docs: DataFrame) -> DataFrame:
    """(stretch, lang, codes, words, counts): the words of long stretches of text of one language as 32-bit numbers in order, 0 where
    a piece begins; word i of a stretch has number i + 1 and occurs counts[i] times there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list[pa.Array], list[np.ndarray]]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            parts, firsts = held.pop(lang)
            size.pop(lang)
            coded = pa.chunked_array(parts, pa.large_binary()).combine_chunks().dictionary_encode()
            code = coded.indices.to_numpy()
            counts = np.bincount(code, minlength=len(coded.dictionary))
            codes = np.insert(code.astype(np.uint32) + np.uint32(1), np.flatnonzero(np.concatenate(firsts)), np.uint32(0))
            words = coded.dictionary.cast(pa.binary()).cast(pa.string())
            ends = pa.array([0, len(words)], pa.int32())
            return pa.record_batch(
                [pa.array([uuid.uuid4().hex]), pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))],
                names=["stretch", "lang", "codes", "words", "counts"],
            )

        for rows, data, at in text_blocks(batches, BLOCK):
            words, row, first = words_of(data, at)
            langs = rows.column("lang").cast(pa.string()).dictionary_encode()
            of = langs.indices.to_numpy()[row]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mask = of == k
                if n := int(mask.sum()):
                    into = held.setdefault(lang, ([], []))
                    into[0].append(words.filter(pa.array(mask)))
                    into[1].append(first[mask])
                    size[lang] = size.get(lang, 0) + n
            while size and (sum(size.values()) >= 4 * STRETCH or max(size.values()) >= STRETCH):
                yield flush(max(size, key=size.get))
                give_back()
        for lang in list(held):
            yield flush(lang)

    return docs.mapInArrow(run, "stretch string, lang string, codes binary, words array<string>, counts array<long>")


@dataclass(frozen=True)
class Packing:
    """n-grams of n word ids of `bits` bits each, as two halves of `half` bits; permuted, their upper bits are the quotient."""

    n: int
    bits: int

    @property
    def half(self) -> int:
        return -(-self.n * self.bits // 2)

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.half) - 1)

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        b, h = np.uint64(self.bits), np.uint64(self.bits - self.bits // 2)  # h: the upper bits of a middle word
        low = np.uint64(self.bits // 2)
        ids = [x.astype(np.uint64) for x in ids]
        if self.n == 2:
            return ids[0], ids[1]
        if self.n == 3:
            return ids[0] << h | ids[1] >> low, (ids[1] & np.uint64((1 << self.bits // 2) - 1)) << b | ids[2]
        return ids[0] << b | ids[1], ids[2] << b | ids[3]

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        b, h, low = np.uint64(self.bits), np.uint64(self.bits - self.bits // 2), np.uint64(self.bits // 2)
        word = np.uint64((1 << self.bits) - 1)
        if self.n == 2:
            return [left, right]
        if self.n == 3:
            return [left >> h, (left & np.uint64((1 << int(h)) - 1)) << low | right >> b, right & word]
        return [left >> b, left & word, right >> b, right & word]

    def permute(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A Feistel network: a bijection, so that quotient and remainder together are the n-gram itself, not a hash of it."""
        for key in ROUNDS:
            left, right = right, left ^ (mixed(right + key) & self.mask)
        return left, right

    def restore(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(ROUNDS):
            left, right = right ^ (mixed(left + key) & self.mask), left
        return left, right

    def quotient(self, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
        """The upper bits, `bits` of them (at most 2 * half and 63)."""
        w = self.half
        if bits <= w:
            return left >> np.uint64(w - bits)
        return left << np.uint64(bits - w) | right >> np.uint64(2 * w - bits)

    def counted(self, left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams in order of the permuted value, with their counts (n: counts to add up)."""
        if not len(left):
            return left, right, np.zeros(0, np.int64)
        w = np.uint64(self.half)
        if 2 * self.half <= 64:
            whole = left << w | right
            order = np.argsort(whole, kind="stable") if n is not None else None
            whole = whole[order] if n is not None else np.sort(whole)
            new = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
            left, right = whole[new] >> w, whole[new] & self.mask
            size = len(whole)
        else:
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
            size = len(left)
            left, right = left[new], right[new]
        counts = np.diff(np.append(new, size)) if n is None else np.add.reduceat(n[order], new)
        return left, right, counts.astype(np.int64)


def _bytes_of(x: np.ndarray, bits: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].tobytes()


def _values_of(data: bytes, n: int, bits: int) -> np.ndarray:
    out, width = np.zeros((n, 8), np.uint8), -(-bits // 8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class QuotientFilter:
    """The form in which the sorted n-grams of one bucket (the first `bucket_bits` bits of the quotient) are sent and merged.

    A bit for each of 2**slot_bits quotients tells whether it is occupied, a bit for each n-gram whether its quotient's run ends
    there; then come the full remainders, a bit for each n-gram that occurs more than once, and the counts of these. Nothing is lost:
    `read` gives back what `write` got.
    """

    packing: Packing
    bucket_bits: int
    slot_bits: int

    @property
    def quotient_bits(self) -> int:
        return min(self.bucket_bits + self.slot_bits, 2 * self.packing.half)

    def write(self, bucket: int, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> bytes:
        w, q = self.packing.half, self.quotient_bits
        quotient = self.packing.quotient(left, right, q) - np.uint64(bucket << (q - self.bucket_bits))
        occupied = np.zeros(1 << (q - self.bucket_bits), bool)
        occupied[quotient.astype(np.int64)] = True
        ends = np.concatenate((quotient[1:] != quotient[:-1], [True]))
        high, low = (left & np.uint64((1 << max(w - q, 0)) - 1), right) if q <= w else (left[:0], right & np.uint64((1 << 2 * w - q) - 1))
        many = n > 1
        return b"".join(
            [len(n).to_bytes(4, "little"), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _bytes_of(high, max(w - q, 0)), _bytes_of(low, w if q <= w else 2 * w - q), np.packbits(many).tobytes(), n[many].astype("<i8").tobytes()]
        )

    def read(self, bucket: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, q = self.packing.half, self.quotient_bits
        n, at = int.from_bytes(data[:4], "little"), 4

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return data[at - size : at]

        def bits(count: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(take(-(-count // 8)), np.uint8), count=count).astype(bool)

        slots = np.flatnonzero(bits(1 << (q - self.bucket_bits)))
        ends = np.flatnonzero(bits(n))
        quotient = np.repeat(slots, np.diff(np.concatenate(([-1], ends)))).astype(np.uint64) + np.uint64(bucket << (q - self.bucket_bits))
        if q <= w:
            high = _values_of(take(n * -(-(w - q) // 8)), n, w - q)
            right = _values_of(take(n * -(-w // 8)), n, w)
            left = quotient << np.uint64(w - q) | high
        else:
            low = _values_of(take(n * -(-(2 * w - q) // 8)), n, 2 * w - q)
            left = quotient >> np.uint64(q - w)
            right = (quotient & np.uint64((1 << q - w) - 1)) << np.uint64(2 * w - q) | low
        many = bits(n)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(data[at:], "<i8")
        return left, right, counts


@dataclass
class Frequent:
    """A bit for each of 2**bits ranges of permuted n-grams: set where a frequent one lies. It may let others through, which are
    counted and found rare; it stops no frequent one."""

    packing: Packing
    bits: int
    shared: Broadcast

    def has(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        slot = self.packing.quotient(*self.packing.permute(left, right), self.bits)
        return (np.frombuffer(self.shared.value, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)] << (slot & np.uint64(7)).astype(np.uint8)) & 128 > 0


def count_ngrams(coded: DataFrame, packing: Packing, least: int, bucket_bits: int, below: Frequent | None) -> DataFrame:
    """(bucket, grams, counts, ranges): the n-grams of coded stretches (ids) with at least `least` occurrences, as arrays of ids.

    Each task writes what it has counted as quotient filters, one for each bucket; a reducer merges a bucket's. Only n-grams whose two
    parts of one word less are frequent (by the filter `below`) are counted: others can't be.
    """
    bucket_bits = min(bucket_bits, 2 * packing.half)
    form = QuotientFilter(packing, bucket_bits, max(1, HELD.bit_length() - 1 - bucket_bits))
    n, range_bits = packing.n, min(FILTER_BITS, 2 * packing.half)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            left, right, counts = packing.counted(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            bucket = packing.quotient(left, right, bucket_bits).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            parts = [(int(bucket[a]), form.write(int(bucket[a]), left[a:b], right[a:b], counts[a:b])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])]
            return pa.record_batch([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "filter"])

        for batch in batches:
            for ids in batch.column("ids"):
                ids = np.frombuffer(ids.as_buffer(), np.uint32)
                for a in range(0, max(len(ids) - n + 1, 0), HELD):
                    part = ids[a : a + HELD + n - 1]
                    places = len(part) - n + 1
                    good = np.ones(places, bool)
                    for k in range(n):
                        good &= part[k : k + places] > 0
                    if below is not None:
                        seen = np.zeros(places + 1, bool)
                        near = np.flatnonzero(np.concatenate((good, [False])) | np.concatenate(([False], good)))
                        seen[near] = below.has(*below.packing.pack([part[k : k + places + 1][near] for k in range(n - 1)]))
                        good &= seen[:-1] & seen[1:]
                    at = np.flatnonzero(good)
                    if len(at):
                        held.append(packing.permute(*packing.pack([part[at + k] for k in range(n)])))
                        size += len(at)
                    if size >= HELD:
                        yield flush()
                        size = 0
                        give_back()
        if held:
            yield flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, parts: list) -> pa.RecordBatch:
            left, right, counts = packing.counted(*(np.concatenate(x) for x in zip(*parts)))
            keep = counts >= least
            left, right, counts = left[keep], right[keep], counts[keep]
            ranges = np.zeros(max(1 << (range_bits - bucket_bits), 1), np.uint8)
            ranges[(packing.quotient(left, right, range_bits) - np.uint64(bucket << (range_bits - bucket_bits))).astype(np.int64)] = 1
            ids = np.stack(packing.unpack(*packing.restore(left, right)), axis=1).astype(np.int64).ravel()
            grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, n, dtype=np.int32)), pa.array(ids))
            ends = pa.array([0, len(counts)], pa.int32())
            packed = zlib.compress(ranges.tobytes(), 1)
            return pa.record_batch([pa.array([bucket], pa.int32()), pa.ListArray.from_arrays(ends, grams), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array([packed], pa.binary())], names=["bucket", "grams", "counts", "ranges"])

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting, now = 0, None
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("filter")):
                if now is not None and bucket != now:
                    yield out(now, parts)
                    parts, waiting = [], 0
                now = bucket
                parts.append(form.read(bucket, data.as_py()))
                waiting += len(parts[-1][0])
                if waiting > max(HELD, 2 * len(parts[0][0])):  # what is merged first stays merged
                    parts, waiting = [packing.counted(*(np.concatenate(x) for x in zip(*parts)))], 0
        if now is not None:
            yield out(now, parts)

    filters = coded.mapInArrow(sent, "bucket int, filter binary").repartition("bucket").sortWithinPartitions("bucket")
    return filters.mapInArrow(merged, "bucket int, grams array<array<long>>, counts array<long>, ranges binary")


#: log2 of the bits of the filter of frequent n-grams that is broadcast.
FILTER_BITS = 27


def frequent_filter(counted: DataFrame, packing: Packing, bucket_bits: int) -> Frequent:
    """The broadcast filter of counted n-grams: 2**FILTER_BITS bits, whatever the input."""
    bits = min(FILTER_BITS, 2 * packing.half)
    bucket_bits = min(bucket_bits, 2 * packing.half)
    width = max(1 << (bits - bucket_bits), 1)
    whole = np.zeros(1 << bits, np.uint8)
    for r in counted.where(F.size("counts") > 0).select("bucket", "ranges").toLocalIterator():
        whole[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(zlib.decompress(r.ranges), np.uint8)
    return Frequent(packing, bits, counted.sparkSession.sparkContext.broadcast(np.packbits(whole).tobytes()))


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations of 2 to `longest` words.

    Null texts are empty and null langs are `und`; rows that repeat a doc_id count each; a table without words gives no rows.

    1. Tasks number the words of long stretches; the words' counts are summed, and frequent words get ids. A join by (lang, word)
       brings the ids back to the stretches: as many rows as distinct words of a stretch, so nothing is broadcast.
    2. Pairs, then triples, then quadruples of ids are counted in quotient filters. What is rare ends there: no part of a frequent
       n-gram is rare.
    3. Cuts, longer candidates and words are joined to the frequent n-grams, which have rows of their own from here on.
    """
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    stretches = materialize(code_stretches(plain), "word-stretches")
    totals = stretches.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    entries = stretches.select("stretch", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("stretch", "lang", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = entries.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(ID_BUCKETS))
    words = words.withColumn("bucket", bucket)
    words = materialize(words.withColumn("nth", F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word")).cast("long")), "frequent-words")
    largest, occurrences = words.agg(F.coalesce(F.max("nth"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = words.select("lang", "word", "n", (F.col("bucket") * largest + F.col("nth")).alias("id"))
    bits = (ID_BUCKETS * largest).bit_length()
    if bits > 32:
        raise ValueError("more frequent words than 32 bits number")
    bucket_bits = min(20, max(8, (occurrences >> 18).bit_length()))

    known = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("stretch").agg(F.collect_list(F.struct("code", "id")).alias("known"))

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, known in zip(batch.column("codes"), batch.column("known")):
                codes = np.frombuffer(codes.as_buffer(), np.uint32)
                number = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.uint32)
                number[known.values.field(0).to_numpy() + 1] = known.values.field(1).to_numpy()
                yield pa.record_batch([pa.array([number[codes].tobytes()], pa.binary())], names=["ids"])
            give_back()

    coded = materialize(stretches.select("stretch", "codes").join(known, "stretch").mapInArrow(renumber, "ids binary"), "coded-stretches")
    grams, below = words.select(F.array("id").alias("gram"), "n"), None
    for n in range(2, longest + 1):
        packing = Packing(n, bits)
        counted = materialize(count_ngrams(coded, packing, least, bucket_bits, below), f"ngrams-{n}")
        grams = grams.unionByName(counted.select(F.explode(F.arrays_zip("grams", "counts")).alias("x")).select(F.col("x.grams").alias("gram"), F.col("x.counts").alias("n")))
        if n < longest:
            below = frequent_filter(counted, packing, bucket_bits)
    return _ranked(materialize(grams, "frequent-ngrams"), words, totals, top)


def _ranked(grams: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    size = F.size("gram")
    candidates = grams.where(size > 1).select("gram", F.col("n").alias("a"))
    cuts = candidates.select("gram", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("gram", "a", "k", F.slice("gram", F.lit(1), F.col("k")).alias("left"), F.slice("gram", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(grams.select(F.col("gram").alias("left"), F.col("n").alias("l")), "left").join(grams.select(F.col("gram").alias("right"), F.col("n").alias("r")), "right")
    score = F.call_function("div", _wide(F.col("a")) * F.lit(2000000).cast("decimal(7,0)"), _wide(F.col("l") + F.col("r")))
    best = cuts.groupBy("gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, size(gram) - 1), s -> transform(sequence(1, size(gram) - s + 1), i -> slice(gram, i, s))))")
    longer = candidates.where(size > 2).select(F.explode(inner).alias("gram"), F.col("a").alias("longer")).groupBy("gram").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, "gram", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 80 * F.col("a")))

    of_lang = words.select(F.col("id").alias("first"), "lang")
    kept = kept.withColumn("first", F.element_at("gram", 1)).join(of_lang, "first").select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = kept.withColumn("place", F.rank().over(order)).where(F.col("place") <= top)  # with all ties: names decide these
    spelled = near.select("*", F.posexplode("gram").alias("at", "id")).join(words.select("id", "word"), "id")
    columns = ["lang", "gram", "a", "l", "r", "score"]
    spelled = spelled.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    named = spelled.withColumn("phrase", F.array_join(F.transform("parts", lambda p: p.word), " "))
    named = named.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: What op12_phrases gives, by counting every n-gram as a string.
OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM s WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, k FROM f WHERE k >= 2),
cut AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS place FROM c),
priced AS (SELECT cut.lang, cut.phrase, a, cut.place, x.n AS l, y.n AS r, (2000000::HUGEINT * a) // (x.n + y.n) AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:cut.place], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[cut.place + 1:], ' ')),
best AS (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) = 1),
sub AS (SELECT lang, a, w, k, unnest(range(2, k)) AS s FROM c WHERE k > 2),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase FROM sub) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))

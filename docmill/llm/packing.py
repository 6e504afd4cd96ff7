"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docmill.llm.common import NULL_ID, narrowed, text_blocks, text_buffers, word_spans

#: letters of ASCII and Latin-1, and signs (no apostrophe, which may open an ending)
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_{|}~"
#: Text bytes whose words are looked up at a time.
BLOCK = 1 << 22


def karmarkar_karp(sizes: list[int], k: int) -> np.ndarray:
    """The window of each size, of k windows with near-equal sums.

    Starts from a partial partition for each size (that size in one window, k - 1 empty) and merges the two of the largest
    imbalance, the fullest window of one with the emptiest of the other, until one is left.
    """
    heap: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    parts: list[tuple[int, int, np.ndarray] | None] = []
    for i, s in enumerate(sizes):
        x = np.zeros(k, np.int64)
        x[0] = s
        sums[i] = x
        parts.append(None)
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable").astype(np.int32)
        both = both[order]
        parts.append((a, b, order))
        sums[len(parts) - 1] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), len(parts) - 1))
    out = np.zeros(len(sizes), np.int64)
    if not sizes:
        return out
    labels = {len(parts) - 1: np.arange(k)}
    for i in range(len(parts) - 1, -1, -1):
        mine = labels.pop(i)
        if (part := parts[i]) is None:
            out[i] = mine[0]
            continue
        a, b, order = part
        named = np.empty(k, np.int64)
        named[order] = mine
        labels[a], labels[b] = named, named[::-1]
    return out


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """Karmarkar-Karp with the least number of windows, risen until none holds more than the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = karmarkar_karp(sizes, k)
        if np.bincount(found, weights=sizes, minlength=1).max(initial=0) <= capacity:
            return found
        k += 1


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of data, in order and without overlap, as strings."""
    covered = np.zeros(len(data) + 1, np.int8)
    full = ends > starts
    covered[starts[full]] += 1
    covered[ends[full]] -= 1
    letters = data[np.cumsum(covered[:-1], dtype=np.int8) > 0]
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])


class Ids:
    """Texts to ids (little-endian 32-bit), through a bounded memory of words; the same ids as the tokenizer gives the text.

    The tokenizer drops white space and never joins what it parts, so that a text's ids are those of its words in turn. It parts
    a run of letters from the signs that follow, and ends each part with an end-of-word id. So letters of one or two bytes that
    have no other form are looked up as such, lower-cased, many in one call without its regular expressions; any other word is
    given to the whole tokenizer. The distinct words of a block are found by Arrow, as are the parts of new ones; dictionaries name
    the place of a word's and a part's ids in one array, and are emptied when they are full.
    """

    MOST = 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.letters.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self._empty()

    def _empty(self) -> None:
        self.words: dict[str, int] = {}
        self.parts: tuple[dict[str, int], dict[str, int]] = {}, {"": 0}  # of letters, of all else
        self.ids, self.at, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), 1  # entry i is ids[at[i] : at[i + 1]]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Puts new entries behind the others; the number of the first."""
        first, end = self.used, int(self.at[self.used]) + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(sizes) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[end - len(ids) : end] = ids
        self.at[first + 1 : first + len(sizes) + 1] = end - len(ids) + np.cumsum(sizes)
        self.used += len(sizes)
        return first

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def _encode_letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(parts) else self._encode(parts)  # not a vocabulary with ends of words

    def _numbers(self, words: list[str], letters: bool) -> np.ndarray:
        """The entries of words, new ones made."""
        known, make = self.parts[not letters], self._encode_letters if letters else self._encode
        missing = list(dict.fromkeys(w for w in words if w not in known))
        for first in range(0, len(missing), 512):
            some = missing[first : first + 512]
            known.update(zip(some, range(at := self._add(*make(some)), at + len(some))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def of(self, texts: list[str] | pa.Array) -> list[bytes]:
        data, at = text_buffers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        starts, ends, first = word_spans(data, at)
        if not len(starts):
            return [b""] * len(texts)
        if self.used > self.MOST:
            self._empty()
        coded = _slices(data, starts, ends).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = self._new(coded.dictionary.take(pa.array(new)))
            self.words.update(zip((words[i] for i in new.tolist()), numbers[new].tolist()))
        ids, sizes = self._gathered(numbers[coded.indices.to_numpy()])
        cuts = np.concatenate(([0], np.cumsum(sizes)))[first].tolist()
        ids = ids.astype("<u4")
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _gathered(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after another, and how many each has."""
        begins = self.at[entries]
        sizes = self.at[entries + 1] - begins
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _new(self, words: pa.Array) -> np.ndarray:
        """Entries for words: letters and the signs after them, or whole."""
        core = pc.ascii_rtrim(words, characters=_SIGNS)
        plain = pc.match_substring_regex(core, _LETTERS).to_numpy(zero_copy_only=False)
        numbers = np.zeros((len(words), 2), np.int64)
        numbers[plain, 0] = self._numbers(pc.utf8_lower(core.filter(pa.array(plain))).to_numpy(zero_copy_only=False).tolist(), True)
        numbers[~plain, 0] = self._numbers(words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist(), False)
        letters, place = text_buffers(words)
        signs = _slices(letters, (place[:-1] + pc.binary_length(core).to_numpy())[plain], place[1:][plain]).dictionary_encode()
        numbers[plain, 1] = self._numbers(signs.dictionary.to_numpy(zero_copy_only=False).tolist(), False)[signs.indices.to_numpy()]
        ids, sizes = self._gathered(numbers.ravel())
        return self._add(ids, sizes.reshape(-1, 2).sum(axis=1)) + np.arange(len(words))


@cache
def ids_of(path: str) -> Ids:
    """One for a worker process, whose tasks share its memory."""
    return Ids(path)


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, piece: int = 512, group: int = 128, slack: int = 8, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A document's ids are those of its text and then end_id (a null or empty text: end_id alone). Whole windows of `capacity`
    ids are cut off first and are sequences of their own; the rest is cut into pieces of at most `piece` ids. A task holds
    such pieces until they fill `group` windows but for `slack` ids a window (the last document is cut there), deals them by
    Karmarkar-Karp, and goes on; what is left at its end is dealt likewise. So nothing is shuffled, a task holds one group, and
    the padding is about slack / capacity and at most a window for each task. sequence_id is unique, not gapless: the task's
    partition and a count. Rows that repeat a doc_id are documents of their own; null doc_ids stay null.
    """
    columns = COLUMNS + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        sequences = 0
        rows: list[tuple] = []
        held: list[tuple] = []  # (doc_id, start, length, all ids of the document)
        total = 0

        def row(piece: tuple, sequence: int, offset: int) -> tuple:
            doc_id, start, length, data = piece
            part = data[4 * start : 4 * (start + length)]
            out = (doc_id, start, length, zlib.crc32(part), len(data) // 4, base + sequence, offset)
            return (*out, bytes(part)) if with_ids else out

        def dealt(pieces: list[tuple]) -> None:
            nonlocal sequences
            found = windows([p[2] for p in pieces], capacity)
            offsets = [0] * (int(found.max(initial=-1)) + 1)
            for p, w in zip(pieces, found.tolist()):
                rows.append(row(p, sequences + w, offsets[w]))
                offsets[w] += p[2]
            sequences += len(offsets)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            rows.clear()
            return out

        types = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [c.split()[0] for c in columns.split(", ")]
        full = group * (capacity - slack)
        for batch in batches:
            for part, _, _ in text_blocks([batch], BLOCK):
                doc_ids = [None if i == NULL_ID else i for i in part.column("doc_id").to_pylist()]
                for doc_id, data in zip(doc_ids, ids.of(part.column("text"))):
                    data = memoryview(data + end)
                    n, start = len(data) // 4, 0
                    while n - start >= capacity:
                        rows.append(row((doc_id, start, capacity, data), sequences, 0))
                        sequences += 1
                        start += capacity
                    while start < n:
                        parts = -(-(n - start) // piece)
                        length = min(-(-(n - start) // parts), full - total)
                        held.append((doc_id, start, length, data))
                        start += length
                        total += length
                        if total == full:
                            dealt(held)
                            held, total = [], 0
                if len(rows) >= 8192:
                    yield flush()
        if held:
            dealt(held)
        if rows:
            yield flush()

    return narrowed(docs).mapInArrow(run, columns)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())

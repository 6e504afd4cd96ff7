"""The words of a block of texts, as Arrow strings, and sound hashes of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

from docmill.llm.common import word_spans

#: A longer word is replaced by a digest behind a byte that no word has.
LONG = 64


def byte_strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


class Words:
    """The words of a block's rows, one after another and each followed by a space: word i is text[at[i] : at[i + 1]].

    first: the index of each row's first word (one value more than rows).
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        starts, ends, self.first = word_spans(data, at)
        sizes = ends - starts
        if (sizes > LONG).any():
            words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
            words = [w if len(w) <= LONG else b"\x0b" + hashlib.blake2b(w, digest_size=32).hexdigest().encode() for w in words]
            sizes = np.array([len(w) for w in words], np.int64)
            letters = np.frombuffer(b"".join(words), np.uint8)
        else:
            covered = np.zeros(len(data) + 1, np.int8)
            covered[starts] += 1
            covered[ends] -= 1
            letters = data[np.cumsum(covered[:-1], dtype=np.int8) > 0] if len(data) else data
        self.at = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.text = np.full(int(self.at[-1]), 32, np.uint8)
        self.text[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters

    def hashes(self) -> np.ndarray:
        """XXH64 of each word."""
        coded = byte_strings(self.text, self.at).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        distinct = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
        return distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.uint64)

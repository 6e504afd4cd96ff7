import random
import zlib
from collections import defaultdict

import numpy as np

from docmill.llm.packing import Ids, karmarkar_karp, pack_documents, public_tokenizer, windows
from tests.llm.helpers import corpus, frame, words


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def laws(rows, got, capacity):
    want = defaultdict(list)
    for i, t in rows:
        want[-1 if i is None else i].append(encoded(t))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[-1 if r.doc_id is None else r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert pieces.keys() == want.keys()
    for i, texts in want.items():
        for ids in texts:
            assert sum(r.length for r in pieces[i]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                part = np.array(texts[0][r.start : r.start + r.length], "<u4").tobytes()
                assert r.start == at and r.doc_tokens == len(texts[0]) and r.ids_crc32 == zlib.crc32(part) and ("ids" not in r or bytes(r.ids) == part)
                at += r.length
            assert at == len(texts[0])
    return len(sequences)


def test_every_id_once(spark):
    rows = corpus(n=30) + [(5000, words(random.Random(2), 4000)), (5001, "a\x1cb c d 's <|endoftext|> x")]
    got = pack_documents(frame(spark, rows).coalesce(1), public_tokenizer(), 256, piece=64, group=16, with_ids=True).collect()
    n = laws(rows, got, 256)
    assert n <= 1.1 * sum(len(encoded(t)) for _, t in rows) / 256 + 2
    laws(rows, pack_documents(frame(spark, rows).repartition(5), public_tokenizer()).collect(), 2048)
    assert pack_documents(frame(spark, []), public_tokenizer()).count() == 0


def test_ids_by_words_are_the_tokenizers():
    ids = Ids(public_tokenizer())
    texts = ["Straße,!! ÀÉ... ÿx a.b c,'s d<|endoftext|> x' <|startoftext|> ßÞ ª1 no: (yes) e\u0301t\u00e9\u0301 q<|"] * 2 + ["It's ONE two three\x85 four", "a\x1d!b", "é ́x", "<|startoftext|>a b<|endoftext|>", "", "İ ſ K", "日本 語"]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == [encoded(t)[:-1] for t in texts]


def test_differencing():
    rng = random.Random(1)
    for k in (1, 2, 7, 40):
        sizes = [rng.randrange(1, 500) for _ in range(200)]
        load = np.bincount(karmarkar_karp(sizes, k), weights=sizes, minlength=k)
        assert len(load) == k and load.max() - load.min() <= 60
    assert karmarkar_karp([], 3).tolist() == [] and sorted(karmarkar_karp([8, 7, 6, 5, 4], 2).tolist()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_windows_rise():
    assert np.bincount(windows([60, 60, 60, 20], 100)).tolist().__len__() == 3
    assert windows([], 10).tolist() == []

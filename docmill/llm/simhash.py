"""SimHash near-duplicates, found by anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import materialize, narrowed, null_if_lowest
from docmill.llm.graph import connected_components
from docmill.llm.hashing import mixed

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_UNPACKED = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of each of a text's word shingles, repeats included, 2**16 at a time; nothing without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return
    width = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    hashed = xxhash.xxh64_intdigest
    for first in range(0, n, 1 << 16):
        last = min(n, first + (1 << 16))
        spans = zip(starts[first:last].tolist(), ends[first + width - 1 : last + width - 1].tolist())
        yield np.fromiter([hashed(line[a:b], 42) for a, b in spans], np.uint64, last - first)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The different hashes of a text's word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def digest(shingles: np.ndarray) -> int:
    """A 64-bit hash of a whole set of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def vote(parts: Iterable[np.ndarray], words64: int) -> list[int]:
    """The SimHash of hashes, as numbers of 64 bits; zeros without any.

    The first 64 bits come from the hashes, further ones from bijections of them.
    """
    counts = np.zeros((words64, 2048), np.int64)
    n = 0
    for h in parts:
        n += len(h)
        for k in range(words64):
            h = mixed(h + np.uint64(k)) if k else h
            counts[k] += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048)
    ones = (counts.reshape(words64, 8, 256) @ _UNPACKED).reshape(words64, 64)  # of each bit, lowest first
    return [sum(1 << i for i in np.flatnonzero(2 * x > n).tolist()) for x in ones]


def fingerprint(text: str, shingle: int, words64: int = 1) -> list[int]:
    """The SimHash of a text's word shingles, repeats included, as numbers of 64 bits; zeros without words."""
    return vote(shingle_hashes(text, shingle), words64)


def with_fingerprints(docs: DataFrame, links: Links) -> DataFrame:
    """(doc_id, fp0, fp1, ... long) of narrowed docs; with least_jaccard those of the shingle sets, and digest long, the set's."""
    names = links.names

    def of(text: str) -> list[int]:
        if links.least_jaccard is None:
            return fingerprint(text, links.shingle, links.words64)
        shingles = shingle_set(text, links.shingle)
        return [*vote([shingles], links.words64), digest(shingles)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([of(x.as_py()) for x in batch.column("text")], np.uint64).reshape(-1, len(names))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(len(names)))], names=["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


# The anchors: words of the perfect binary Golay code of length 23 and radius 3, taken over 23 bits or several times 23 bits.
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a fixed value of the code
LENGTH, RADIUS = 23, 3


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder modulo the generator: 0 for code words, 2048 values."""
    x = x.copy()
    for bit in range(LENGTH - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GENERATOR << (bit - 11), 0)
    return x


@cache
def patterns(excess: int) -> np.ndarray:
    """By syndrome (2048 rows, filled with -1): the errors that lead to a code word and flip RADIUS + excess bits, or for
    excess 0 up to RADIUS, of which each syndrome has one."""
    weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
    found = np.array([sum(1 << i for i in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
    of = syndrome(found)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=2048)
    table = np.full((2048, counts.max()), -1, np.int64)
    nth = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    table[of[order], nth] = found[order]
    return table


@dataclass(frozen=True)
class Links:
    """Which fingerprints link, and how they meet.

    tables: for each, the places of one or more blocks of 23 bits; a table's anchors are a code word for each of its blocks.
    reach: a fingerprint goes to every anchor within the radius plus `reach` bits. threshold: bits in which linked ones may
    differ. If all tables together can't see more than `reach` bits of a difference of `threshold` (one table: reach ==
    threshold), no link is missed. least_jaccard: if given, fingerprints (of the sets of shingles then) only find candidates, and
    those link whose sets of shingles have at least this Jaccard similarity.
    """

    shingle: int
    words64: int
    tables: tuple[tuple[int, ...], ...]
    reach: int
    threshold: int
    least_jaccard: float | None = None

    @property
    def names(self) -> list[str]:
        """The columns that tell distinct texts apart: fp0, fp1, ..., and digest with least_jaccard."""
        return [*(f"fp{k}" for k in range(self.words64)), *(["digest"] if self.least_jaccard is not None else [])]


#: Two fingerprints of 64 bits at 2 bits or fewer, every one of them, over 2**24 anchors.
EXACT = Links(shingle=3, words64=1, tables=((0, 23),), reach=2, threshold=2)
#: Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Sets of that similarity (and one size) differ in
#: 15 % of their bits, 39 of 256 give or take 6; unrelated ones in 128 give or take 8. Candidates differ in 60 bits or fewer; a
#: block's home meets the other's reach with a chance of 0.39 at 0.8, 0.48 at 0.85, 0.58 at 0.9, and there are twelve.
SIMILAR = Links(shingle=5, words64=4, tables=tuple((64 * k + at,) for k in range(4) for at in (0, 23, 41)), reach=1, threshold=60, least_jaccard=0.8)


def anchors(fps: np.ndarray, links: Links) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indices into fps, anchors, whether it's the home anchor) of every anchor within the covering radius plus reach.

    fps: a row of 64-bit numbers for each fingerprint. The home anchor lies within the radius in each block. A fingerprint at
    `reach` bits from another one, t1 of them in one block and t2 in the next, has the other's home among its own anchors, since
    RADIUS + t1 and RADIUS + t2 reach it.
    """
    for table, blocks in enumerate(links.tables):
        bits = [(fps[:, at // 64] >> np.uint64(at % 64)).astype(np.int64) & (1 << LENGTH) - 1 for at in blocks]
        of = [syndrome(x) for x in bits]
        for excess in product(range(links.reach + 1), repeat=len(blocks)):
            if sum(excess) > links.reach:
                continue
            row, anchor = np.arange(len(fps)), np.full(len(fps), table, np.int64)
            for e, x, s in zip(excess, bits, of):
                p = patterns(e)[s[row]]
                i, j = np.nonzero(p >= 0)
                row = row[i]
                anchor = anchor[i] << 12 | (x[row] ^ p[i, j]) >> 11  # a code word's upper 12 bits name it
            yield row, anchor, not any(excess)


def at_anchors(fps: DataFrame, links: Links, carry: tuple[str, ...] = ()) -> DataFrame:
    """(anchor, home, id, carried longs, fp0, ...): each distinct fingerprint at every anchor that it has to reach."""
    names = ["id", *carry, *(f"fp{k}" for k in range(links.words64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                columns = [batch.column(c).slice(first, 4096).to_numpy(zero_copy_only=False) for c in names]
                for i, anchor, home in anchors(np.stack(columns[-links.words64 :], axis=1).view(np.uint64), links):
                    yield pa.record_batch([pa.array(anchor), pa.array(np.full(len(i), home)), *(pa.array(x[i]) for x in columns)], names=["anchor", "home", *names])

    return fps.select(*names).mapInArrow(run, "anchor long, home boolean, " + ", ".join(f"{n} long" for n in names))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces links by stars that connect the same nodes: a link from each node to the least of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        low = low[root]
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    move = root != np.arange(len(nodes))
    return nodes[move], nodes[root[move]]


_PAIRS = 1 << 21


def _near(threshold: int, anchor: np.ndarray, home: np.ndarray, *fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bits) of rows x and y of whole anchor groups that are near, compared home against all, in bounded steps."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    group = np.repeat(np.arange(len(starts)), sizes)
    homes = np.flatnonzero(home & (sizes[group] > 1))
    work = np.cumsum(sizes[group[homes]])
    first = 0
    while first < len(homes):
        last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + _PAIRS, side="right")))
        h = homes[first:last]
        n = sizes[group[h]]
        x = np.repeat(h, n)
        y = np.repeat(starts[group[h]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits = np.zeros(len(x), np.uint16)
        for fp in fps:
            bits += np.bitwise_count(fp[x].view(np.uint64) ^ fp[y].view(np.uint64))
        near = (bits <= threshold) & (x != y)
        if near.any():
            yield x[near], y[near], bits[near]
        first = last


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns, of which the first is sorted, cut where its value changes."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)
        if now[0][0] != now[0][-1]:
            last = int(np.searchsorted(now[0], now[0][-1]))
            yield tuple(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in now)))
            held = [tuple(x[last:] for x in now)]
        elif held and held[-1][0][-1] != now[0][0]:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = [now]
        else:
            held.append(now)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def link_forest(fps: DataFrame, links: Links) -> DataFrame:
    """(a, b): links between ids of distinct fingerprints (id, fp0, ...) that connect them just as all links do.

    An anchor's group is compared home fingerprints against all, a few million pairs at a time, and leaves a forest, at most a
    link for each fingerprint: a group's links are never emitted pair by pair. Only one group's distinct fingerprints (17
    bytes and more each) are held: the code's geometry spreads fingerprints over the anchors, and copies count once.
    """
    columns = ["anchor", "home", "id", *(f"fp{k}" for k in range(links.words64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, home, ids, *fps in _whole_groups(batches, columns):
            found = [forest(ids[x], ids[y]) for x, y, _ in _near(links.threshold, anchor, home, *fps)]
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found)))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return at_anchors(fps, links).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "a long, b long")


#: Bytes of shingle sets of a tile: a task compares two tiles of one group of candidates.
TILE_BYTES = 1 << 22


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut where one of the keys changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != v[0] for k, v in zip(keys, values)):
            yield pa.Table.from_batches(held)
            held = []
        for first, last in zip(cuts, cuts[1:]):
            held.append(batch.slice(first, last - first))
            if last < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _similar_within(group: pa.Table, links: Links) -> tuple[list[int], list[int]]:
    """Links that connect the ids of two tiles (right: the second one) just as all their near copies do: a pair is compared only
    while nothing connects it."""
    ids, right = group.column("id").to_pylist(), group.column("right").to_numpy(zero_copy_only=False)
    fps = np.stack([group.column(f"fp{k}").to_numpy() for k in range(links.words64)], axis=1).view(np.uint64)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
    sizes = np.array([len(x) for x in sets])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seconds = np.flatnonzero(right) if right.any() else np.arange(len(ids))
    a, b = [], []
    for x in np.flatnonzero(~right).tolist():
        ys = seconds if right.any() else seconds[x + 1 :]
        near = np.bitwise_count(fps[ys] ^ fps[x]).sum(axis=1) <= links.threshold
        near &= np.minimum(sizes[ys], sizes[x]) >= links.least_jaccard * np.maximum(sizes[ys], sizes[x]) - 1  # else they can't be
        for y in ys[near].tolist():
            if (i := find(x)) != (j := find(y)):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both and both / (sizes[x] + sizes[y] - both) >= links.least_jaccard:
                    root[max(i, j)] = min(i, j)
                    a.append(ids[x])
                    b.append(ids[y])
    return a, b


def similar_links(docs: DataFrame, classes: DataFrame, links: Links) -> DataFrame:
    """(a, b): links between classes (id, fp0, ..., digest) of narrowed docs that connect them just as do all pairs of a Jaccard
    similarity of least_jaccard or more whose candidates a chain of candidates connects.

    Candidates (fingerprints at links.threshold or fewer bits) leave the anchors as a forest, which gives groups of texts that may be
    near copies. A group is dealt into tiles of about TILE_BYTES of shingle sets, and each two tiles of it are compared in one task,
    by fingerprints first and then by the sets; what leaves is again a forest. So neither candidates nor near copies are ever rows
    pair by pair, and a large group spreads over tasks. Classes of one id are one document.
    """
    classes = materialize(classes, "classes")
    groups = connected_components(link_forest(classes, links))
    members = materialize(classes.join(groups, F.col("id") == F.col("node")).drop("node"), "candidates")
    texts = docs.join(members.select("id", "digest"), F.col("doc_id") == F.col("id")).select("id", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, sets = [], [], []
            for i, d, text in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("text")):
                shingles = shingle_set(text.as_py(), links.shingle)
                if digest(shingles) == d % 2**64:  # a repeated doc_id has other texts
                    ids.append(i)
                    digests.append(d)
                    sets.append(shingles.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(sets, pa.binary())], names=["id", "digest", "shingles"])

    sets = texts.mapInArrow(run, "id long, digest long, shingles binary").dropDuplicates(["id", "digest"])
    fps = [f"fp{k}" for k in range(links.words64)]
    rows = materialize(members.join(sets, ["id", "digest"]).select("root", "id", "digest", *fps, "shingles"), "shingles")
    tiles = rows.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles") + 64) / TILE_BYTES).cast("int").alias("tiles"))
    dealt = rows.join(tiles, "root").withColumn("tile", F.pmod(F.xxhash64("id", "digest"), F.col("tiles")).cast("int"))
    left = dealt.withColumn("lo", F.col("tile")).withColumn("hi", F.explode(F.sequence("tile", F.col("tiles") - 1))).withColumn("right", F.lit(False))
    right = dealt.where("tile > 0").withColumn("hi", F.col("tile")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("tile") - 1))).withColumn("right", F.lit(True))
    columns = ["root", "lo", "hi", "right", "id", *fps, "shingles"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _stretches(batches, ["root", "lo", "hi"]):
            if group.num_rows > 1:
                x, y = _similar_within(group, links)
                a += x
                b += y
                if len(a) >= 1 << 16:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                    a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    met = left.select(columns).unionByName(right.select(columns)).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "right")
    return met.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, links: Links = EXACT) -> DataFrame:
    """(doc_id, fp0 long, ..., component_id), a row for each row of docs.

    Fingerprints link at links.threshold or fewer differing bits, with links.least_jaccard also by their sets of shingles; component_id
    is the smallest doc_id reachable over links. The words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; fewer words
    than a shingle has are one shingle; without words (null or empty texts) the fingerprint is 0 and links like any other. Rows that
    repeat a doc_id are one document, so their fingerprints count as linked. A null doc_id sorts before all others and gives a null
    component_id.
    """
    docs, names = narrowed(docs), links.names
    prints = materialize(with_fingerprints(docs, links), "fingerprints")
    classes = prints.groupBy(names).agg(F.min("doc_id").alias("id"))  # copies leave before anything is replicated
    found = connected_components(link_forest(classes, links) if links.least_jaccard is None else similar_links(docs, classes, links))
    labels = classes.join(found, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("root", "id").alias("component_id"))
    return prints.join(labels, names).select(
        null_if_lowest(F.col("doc_id")).alias("doc_id"), *names, null_if_lowest(F.col("component_id")).alias("component_id")
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")

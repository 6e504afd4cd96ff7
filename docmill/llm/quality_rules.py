"""Quality rules: word and line statistics, and bands of n-gram perplexity for each language."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import char_model
from docmill.llm.common import BLANKS, id_or_lowest, materialize, null_if_lowest, text_or_empty

SYMBOLS = b"#*$%&|<>"
ORDER, BITS = 4, 5
SIZE = 1 << BITS
BLANK, DIGIT, SIGN, SYMBOL, LETTER, OTHER = range(26, 32)


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; see quality_rules."""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, BLANKS)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    duplicates = 0
    for line in data.split(b"\n"):
        if line in seen:
            duplicates += bool(line.strip(BLANKS))
        else:
            seen.add(line)
    return len(words), chars, symbols, duplicates, _repeat_words(words)


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(known)
    pairs = ids[:-1] * n + ids[1:]
    if n > 1 << 20:  # three would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


@cache
def symbol_table() -> np.ndarray:
    """The class of each code point below 2**16: a letter's by its base letter whatever the case, and six more classes.

    Letters of other scripts than Latin are dealt over the 26 classes by their code points, so that each script has texture.
    """
    table = np.full(1 << 16, OTHER, np.uint8)
    for point in range(1 << 16):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            base = unicodedata.normalize("NFKD", c)[0].lower()
            table[point] = ord(base) - 97 if "a" <= base <= "z" else ord(base) % 26
        elif kind[0] == "N":
            table[point] = DIGIT
        elif kind[0] == "Z" or c in "\t\n\v\f\r":
            table[point] = BLANK
        elif kind[0] == "S" or c.encode("utf-8", "replace") in (bytes([b]) for b in SYMBOLS):
            table[point] = SYMBOL
        elif kind[0] == "P":
            table[point] = SIGN
    return table


@cache
def capitals() -> np.ndarray:
    """Which code points below 2**16 are capital letters."""
    return np.array([unicodedata.category(chr(p)) == "Lu" for p in range(1 << 16)])


def codes(text: str) -> np.ndarray:
    """The n-gram that ends at each character, as a number of ORDER * BITS bits; blanks stand before the text.

    A capital inside a word counts as LETTER, the class of letters other than a to z.
    """
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), (1 << 16) - 1)
    classes = symbol_table()[points]
    inner = capitals()[points[1:]] & ((classes[:-1] < BLANK) | (classes[:-1] == LETTER))
    classes[1:][inner] = LETTER
    padded = np.concatenate([np.full(ORDER - 1, BLANK, np.uint8), classes]).astype(np.int32)
    out = padded[: len(classes)]
    for k in range(1, ORDER):
        out = out << BITS | padded[k : k + len(classes)]
    return out


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all texts. A task sums its own counts first, at most 2**20 for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}

        def summed(lang: str) -> None:
            if lang not in counts:
                counts[lang] = np.zeros(1 << ORDER * BITS, np.int64)
            counts[lang] += np.bincount(np.concatenate(held.pop(lang)), minlength=1 << ORDER * BITS)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                summed(lang)
            for lang, n in counts.items():
                code = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(code)), pa.array(code.astype(np.int32)), pa.array(n[code])], names=["lang", "code", "n"])
            counts.clear()

        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                got = codes(text.as_py())
                held.setdefault(lang, []).append(got)
                sizes[lang] = sizes.get(lang, 0) + len(got)
                if sizes[lang] > 1 << 21:
                    summed(lang)
                    sizes[lang] = 0
                if len(held) + len(counts) > 24:
                    yield from flush()
                    sizes.clear()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The discount of a count of 0, 1, 2, and 3 or more (Chen and Goodman 1998)."""
    n = [float((counts == k).sum()) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *(float(np.clip(x, 0.05 * k, 0.95 * k)) for k, x in enumerate(d, 1))])


def _interpolated(counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, back-off weight of each context): counts has its contexts in rows, lower the shorter contexts' P in its rows."""
    d = _discounts(counts)
    total = counts.sum(axis=1)
    seen = total > 0
    kinds = np.stack([(counts == 1).sum(axis=1), (counts == 2).sum(axis=1), (counts > 2).sum(axis=1)], axis=1)
    weight = np.where(seen, kinds @ d[1:] / np.maximum(total, 1), 1.0)
    own = np.maximum(counts - d[np.minimum(counts, 3)], 0) / np.maximum(total, 1)[:, None]
    shorter = np.tile(lower, (len(counts) // len(lower), 1))
    return own + weight[:, None] * shorter, weight


@dataclass
class KneserNey:
    """A modified Kneser-Ney model of one language, in sorted hash arrays.

    hashes: the n-grams that occur, as numbers (no two share one), sorted; logs: their log10 probabilities. For the others,
    back[context] + shorter[last three].
    """

    hashes: np.ndarray
    logs: np.ndarray
    back: np.ndarray
    shorter: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, n: np.ndarray) -> KneserNey:
        counts = np.zeros((SIZE,) * ORDER, np.int64)
        counts.ravel()[code] = n
        # lower orders count the different n-grams that end so
        orders = [counts]
        for _ in range(ORDER - 1):
            orders.append((orders[-1] > 0).sum(axis=0))
        p = np.full((1, SIZE), 1 / SIZE)
        for c in reversed(orders[1:]):
            p, _ = _interpolated(c.reshape(-1, SIZE), p)
        shorter = p
        p, weight = _interpolated(counts.reshape(-1, SIZE), shorter)
        hashes = np.sort(code).astype(np.uint32)
        return cls(hashes, np.log10(p.ravel()[hashes]).astype(np.float32), np.log10(weight).astype(np.float32), np.log10(shorter.ravel()).astype(np.float32))

    def of_codes(self, code: np.ndarray) -> np.ndarray:
        """The log10 probability of each n-gram."""
        at = np.minimum(np.searchsorted(self.hashes, code), len(self.hashes) - 1)
        return np.where(self.hashes[at] == code, self.logs[at], self.back[code >> BITS] + self.shorter[code & (1 << (ORDER - 1) * BITS) - 1])


def fit(docs: DataFrame) -> dict[str, KneserNey]:
    """A model for each lang of docs (lang, text); what comes to the driver has at most 2**20 rows for a language."""
    models = {}
    rows = count_ngrams(docs).toArrow().to_pandas()
    for lang, part in rows.groupby("lang"):
        models[lang] = KneserNey.of(part["code"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
    return models


def quality_rules(docs: DataFrame, languages: int = 32, width: float = 2.5, least_spread: float = 0.01, held: int = 1 << 21) -> DataFrame:
    """A row for each row of docs: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    perplexity, letter_perplexity).

    Words are `[^\\x20\\x09-\\x0D]+` of the text (null: none). word_chars: code points in words; n_symbols: characters of
    `[#*$%&|<>]`; n_dup_lines: lines (split at \\n) with a word that equal an earlier one; n_repeat_words: words in 3-word windows
    that the text has twice or more. base_failed: under 50 words, or over half of them n_repeat_words. kept: not base_failed, and
    both perplexities within their bands of the language.

    letter_perplexity is that of the text's code points, none of them folded, under a modified Kneser-Ney 5-gram model of its
    language. Texts are dealt into two halves by hash, and each is scored by the model of the other half, so that no text vouches
    for its own noise. The n-grams grow with the corpus: Spark counts them and joins each order to the next lower one, and they are
    broadcast in ranges of about `held`, each but the first for one more pass over the texts.

    perplexity is that of the characters folded to 32 classes (shapes of words, whatever the script's size) under a 4-gram model,
    counted over all texts of the language in Spark; at most 2**20 n-grams for a language.

    A band is the median of the log perplexity of the documents that haven't base_failed, `width` times the distance to the lower
    and to the upper decile (at least least_spread) down and up: for a bell-shaped spread about three standard deviations. Each
    language has models of its own, and null is one more; `languages` of them are held and broadcast at a time, and documents are
    scored by as many passes as that takes, each over its own languages' rows. No words: perplexities null. Rows that repeat a
    doc_id count each.
    """
    docs = docs.select(id_or_lowest().alias("doc_id"), text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    docs = docs.withColumns({"fold": char_model.fold(), "digest": F.md5("text")})
    names = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]  # a row for each language
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    row = ["doc_id", "lang", "digest"]

    def scored_by(models: Broadcast, letters: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    features = base_features(text)
                    rows.append((*features, len(text), float(-models.value[lang].of_codes(codes(text)).mean(dtype=np.float64)) if features[0] else None))
                if rows:
                    *numbers, logs = zip(*rows)
                    letter_logs = pa.array(char_model.sums(letters.value, batch))
                    yield pa.record_batch([*(batch.column(c) for c in row), *(pa.array(x, pa.int64()) for x in numbers), pa.array(logs, pa.float64()), letter_logs], names=[*row, *columns, "n_letters", "log_perplexity", "letter_logs"])

        return run

    def more_by(letters: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.record_batch([*(batch.column(c) for c in row), pa.array(char_model.sums(letters.value, batch))], names=[*row, "more_logs"])

        return run

    broadcast = docs.sparkSession.sparkContext.broadcast
    keyed = "doc_id long, lang string, digest string, "
    schema = keyed + "".join(f"{c} long, " for c in columns) + "n_letters long, log_perplexity double, letter_logs double"
    parts, more = [], []
    for first in range(0, max(len(names), 1), languages):
        some = names[first : first + languages]
        own = docs if len(names) <= languages else docs.where(F.col("lang").isin(some))
        for k, letters in enumerate(char_model.ranges(char_model.fit(char_model.count(own)), held)):
            if k == 0:
                parts.append(own.mapInArrow(scored_by(broadcast(fit(own)), broadcast(letters)), schema))
            else:  # rows of one doc_id and text have one sum
                more.append(own.mapInArrow(more_by(broadcast(letters)), keyed + "more_logs double").groupBy(*row).agg(F.max("more_logs").alias("more_logs")))
    scored = reduce(DataFrame.union, parts)
    if more:
        added = reduce(DataFrame.union, more).groupBy(*row).agg(F.sum("more_logs").alias("more_logs"))
        scored = scored.join(added, row, "left").withColumn("letter_logs", F.col("letter_logs") + F.coalesce("more_logs", F.lit(0.0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    by_letter = F.when(F.col("n_words") > 0, -F.col("letter_logs") / F.col("n_letters"))
    scored = materialize(scored.withColumns({"base_failed": failed, "letter_log_perplexity": by_letter}).drop("digest", "n_letters", "letter_logs", "more_logs"), "quality")
    measures = ["log_perplexity", "letter_log_perplexity"]
    deciles = [F.percentile_approx(c, [0.1, 0.5, 0.9], 10_000).alias(f"{c}_q") for c in measures]
    bands = scored.where(~F.col("base_failed")).groupBy("lang").agg(*deciles)  # a row for each language
    inside = F.lit(True)
    for c in measures:
        low, middle, high = (F.col(f"{c}_q")[k] for k in range(3))
        down, up = F.greatest(middle - low, F.lit(least_spread)), F.greatest(high - middle, F.lit(least_spread))
        inside = inside & F.coalesce(F.col(c).between(middle - width * down, middle + width * up), F.lit(False))
    return scored.join(F.broadcast(bands), "lang", "left").select(
        null_if_lowest(F.col("doc_id")).alias("doc_id"), *columns, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), F.pow(F.lit(10.0), "letter_log_perplexity").alias("letter_perplexity"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

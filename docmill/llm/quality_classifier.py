"""A quality classifier by compression with two dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import narrowed, null_if_lowest, text_or_empty


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; -1 for a null doc_id, which no fold has."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1)).cast("int")


#: the first bytes of a trained zstandard dictionary, a fixed value of the format
MAGIC = (0xEC30A437).to_bytes(4, "little")


@dataclass
class CompressionModel:
    """Two zstandard dictionaries and a logistic calibration of what they tell."""

    good: bytes
    bad: bytes
    weights: list[float]
    block: int = 4096
    level: int = 3

    def __post_init__(self) -> None:
        self._made = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"} | {"_made": None}

    def features(self, text: bytes) -> tuple[float, float]:
        """The normalised size difference of the whole text and of its worst block: above 0 if the good dictionary is the better.

        The text is compressed in blocks, since over a long stretch either dictionary gives way to what has been read.
        """
        if self._made is None:
            dicts = [zstandard.ZstdCompressionDict(d) if d[:4] == MAGIC else zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
            for d in dicts:
                d.precompute_compress(level=self.level)
            self._made = [zstandard.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False) for d in dicts]
        g, b = self._made
        whole_g = whole_b = 0
        worst = 1.0
        n = max(1, round(len(text) / self.block))
        for i in range(n):
            part = text[len(text) * i // n : len(text) * (i + 1) // n]
            x, y = len(g.compress(part)), len(b.compress(part))
            whole_g += x
            whole_b += y
            worst = min(worst, (y - x) / (y + x))
        return (whole_b - whole_g) / (whole_b + whole_g), worst

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where the texts are too few for training, their last bytes."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Intercept and weights of a logistic regression, each row counted `weight` times."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 1 << 16, dictionary: int = 1 << 16) -> CompressionModel:
    """Fits on a bounded sample of labelled rows: at most per_class texts (up to `longest` bytes each) of each label, those with
    the least hash of doc_id.

    Two thirds of them train the dictionaries; the others, which these haven't seen, the calibration. Rows with a null label or
    doc_id are left out, and so are doc_ids whose labels contradict each other; of several texts of one doc_id the least counts.
    Where one class has no rows, every score is the share of label 1 (0.5 without any rows).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("mark")).where("doc_id is not null and mark in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("mark").alias("mark"), F.max("mark").alias("other")).where("mark = other").drop("other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.octet_length("text") <= longest)
    seen: dict[int, list[bytes]] = {}
    for mark in (0, 1):
        # the bounded sample is drawn from the ids first, so that few texts are joined
        chosen = marks.where(F.col("mark") == mark).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        seen[mark] = [r.text.encode() for r in rows.select("text").collect()]
    n0, n1 = len(seen[0]), len(seen[1])
    if not n0 or not n1:
        p = 0.5 if not n0 + n1 else (n1 + 0.5) / (n0 + n1 + 1)
        return CompressionModel(b"\n" * 8, b"\n" * 8, [float(np.log(p / (1 - p))), 0.0, 0.0])
    train = {m: [t for i, t in enumerate(x) if i % 3] or x for m, x in seen.items()}
    test = {m: x[::3] for m, x in seen.items()}
    model = CompressionModel(_dictionary(train[1], dictionary), _dictionary(train[0], dictionary), [0.0, 0.0, 0.0])
    x = np.array([model.features(t) for m in (0, 1) for t in test[m]])
    y = np.array([m for m in (0, 1) for _ in test[m]], float)
    # the sample has as many rows of either label; each stands for its share of all labelled rows
    counts = {r.mark: r.n for r in marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.where(y == 1, counts[1] / len(test[1]), counts[0] / len(test[0]))
    model.weights = _logistic(x, y, weight * len(y) / weight.sum())
    return model


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, score), a row for each row of docs: the chance of label 1 by the text alone. Null texts count as empty ones, and
    empty ones get the calibration's value for no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([model.features(t.as_py().encode()) for t in batch.column("text")])
                yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    return narrowed(docs).mapInArrow(run, "doc_id long, score double").withColumn("doc_id", null_if_lowest(F.col("doc_id")))


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from labelled rows whose crc32(doc_id as text) mod folds isn't held_out."""
    model = fit(docs.where(remainder(folds) != held_out), labels.where(remainder(folds) != held_out))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (remainder(folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

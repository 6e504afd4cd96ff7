"""What the operators share: the scratch folder, written tables and Arrow text blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: it sorts before every other one.
NULL_ID = -(2**63)
#: `[\x20\x09-\x0D]`, the separators of words.
BLANKS = b" \t\n\x0b\x0c\r"
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local mode, tests) a new temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docmill-"))
    return shared_dir(spark)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder (a folder for each value of `by`) and reads it back: lineage ends here and a lost executor
    costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_or_lowest(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID)).cast("long")


def null_if_lowest(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def narrowed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the lowest) and text (null: empty) alone, so that no other column can clash."""
    return docs.select(id_or_lowest().alias("doc_id"), text_or_empty().alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of an Arrow column, one after another, and the len + 1 offsets into them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def text_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches between rows into blocks of about `most` text bytes (a longer text is a block of its own).

    Yields the rows, their bytes and their offsets.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = text_buffers(batch.column("text"))
        first = 0
        while first < batch.num_rows:
            end = max(int(np.searchsorted(at, at[first] + most, side="right")) - 1, first + 1)
            yield batch.slice(first, end - first), data[at[first] : at[end]], at[first : end + 1] - at[first]
            first = end
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker process lives through many tasks, and what it keeps adds up on an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word `[^\x20\x09-\x0D]+` of a block starts and ends, and the index of each row's first word (len + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # a row starts here
    edge[at] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1] | edge[1:-1])))
    ends = np.flatnonzero(word & np.concatenate((~word[1:] | edge[1:-1], [True]))) + 1
    return starts, ends, np.searchsorted(starts, at)

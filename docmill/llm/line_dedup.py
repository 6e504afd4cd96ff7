"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import id_or_lowest, materialize, null_if_lowest, shared_dir, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(line: Column) -> Column:
    """16 bytes for a line's key; null for an empty key, which never counts."""
    key = line_key(line)
    return F.when(key != "", F.unhex(F.md5(key)))


MANIFEST = "seq long, run string, level int, live boolean, buckets int"


class LineRuns:
    """A store of sorted runs (line hash, number of documents up to and with the run) in a folder that all executors share.

    A batch adds one run to level 0. As soon as a level holds `fanout` runs they are merged into one run of the next level,
    so that n batches leave O(fanout * log n) runs and each row is rewritten O(log n) times. Hashes that have reached
    `min_docs` are closed: a later batch merge-anti-joins them away before it adds its own run, so that a hash is closed by one
    row of one run.

    Every run is bucketed and sorted by hash into the same number of buckets, one file for each, so that Spark merge-joins a batch
    to the runs bucket by bucket: it shuffles and sorts only the batch and reads the runs in the order in which they are stored. The manifest table tells which runs live; each change of it is one appended file,
    written after the run itself, so that a batch that breaks off leaves the store as it was. Opening a folder again (the number
    of buckets is that of its first run) goes on from the manifest. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._seq = 0
        # lets a scan of a bucketed table with one file a bucket keep its order; Spark checks the files and sorts where there are more
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        for seq, run, level, live, self.buckets in self._manifest():
            self._note(run, level, live)
            self._seq = seq + 1

    def _manifest(self) -> list[tuple]:
        """The changes so far, in order; there are two or so for each batch."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return [tuple(r) for r in rows.orderBy("seq", "live").collect()]

    def _note(self, run: str, level: int, live: bool) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run) if live else self.levels[level].remove(run)

    def _change(self, changes: list[tuple[str, int, bool]]) -> None:
        rows = [(self._seq, run, level, live, self.buckets) for run, level, live in changes]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._seq += 1
        for change in changes:
            self._note(*change)

    def _table(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):  # a run of an earlier session
            self.spark.sql(
                f"CREATE TABLE {run} (hash BINARY, n_docs BIGINT) USING parquet "
                f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'"
            )
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        run = f"line_run_{uuid.uuid4().hex}"
        sorted_rows = rows.select("hash", "n_docs").write.bucketBy(self.buckets, "hash").sortBy("hash")
        sorted_rows.option("path", f"{self.path}/{run}").saveAsTable(run, format="parquet")
        return run

    def _read(self, runs: list[str]) -> DataFrame:
        """The rows of several runs. As files, not as tables: a union of bucketed tables doesn't bring equal hashes together."""
        if not runs:
            return self.spark.createDataFrame([], "hash binary, n_docs long")
        return self.spark.read.schema("hash binary, n_docs long").parquet(*[f"{self.path}/{run}" for run in runs])

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def totals(self, runs: list[str] | None = None) -> DataFrame:
        """(hash, n_docs) over the runs (none given: over all)."""
        return self._read(self.runs if runs is None else runs).groupBy("hash").agg(F.max("n_docs").alias("n_docs"))

    def closed(self) -> DataFrame:
        """(hash, n_docs) of the hashes found in at least min_docs documents so far; those after a hash closed aren't in n_docs."""
        return self._read(self.runs).where(F.col("n_docs") >= self.min_docs)

    def fresh(self, lines: DataFrame) -> DataFrame:
        """(hash, n_docs) of the batch's hashes that aren't closed, with the documents of the runs."""
        batch = lines.select("doc_id", "hash").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("new"))
        before = F.lit(0)
        for k, run in enumerate(self.runs):
            batch = batch.join(self._table(run).select("hash", F.col("n_docs").alias(f"n{k}")).hint("merge"), "hash", "left")
            before = F.greatest(before, F.coalesce(f"n{k}", F.lit(0)))
        return batch.where(before < self.min_docs).select("hash", (F.col("new") + before).cast("long").alias("n_docs"))

    def add(self, lines: DataFrame) -> None:
        """lines: (doc_id, hash) of the batch; all rows of a doc_id have to be in one batch, and count once."""
        changes = [(self._write(self.fresh(lines)), 0, True)]
        live = [list(level) for level in self.levels] or [[]]
        live[0].append(changes[0][0])
        level = 0
        while len(live[level]) >= self.fanout:
            merged = self._write(self.totals(live[level]))
            changes += [(run, level, False) for run in live[level]] + [(merged, level + 1, True)]
            live[level] = []
            level += 1
            if level == len(live):
                live.append([])
            live[level].append(merged)
        # a run that comes and goes in one batch isn't in the manifest at all
        gone = {run for run, _, there in changes if not there} & {run for run, _, there in changes if there}
        self._change([c for c in changes if c[0] not in gone])


#: A hash found in more than one of 2^14 of all (document, line) rows is a hot one; so there are fewer than 2^14 of them.
HOT_SHARE = 1 << 14


def feed_lines(docs: DataFrame, min_docs: int, batches: int, fanout: int) -> tuple[LineRuns, DataFrame]:
    """The runs after all lines of docs, and the lines (doc_id, hash). The documents are fed in `batches` batches, as a crawl would; the
    hashes (16 bytes a line, once for each document) are computed in one pass and written batch by batch; texts aren't moved."""
    hashes = F.array_distinct(F.transform(F.split(F.col("text"), "\n", -1), key_hash))
    lines = docs.select("doc_id", F.explode(hashes).alias("hash")).where(F.col("hash").isNotNull())
    lines = materialize(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line-hashes", by="batch")
    runs = LineRuns(docs.sparkSession, None, min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    return runs, lines.select("doc_id", "hash")


#: So many closed hashes (16 bytes each) are broadcast at most; more of them are joined.
MOST_BROADCAST = 1 << 20


def frequent_lines(closed: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, hash) for every document and line of it (lines) whose hash is closed. The rows of a hot hash don't meet in one task:
    these hashes, fewer than 2^14, are broadcast, and all others joined."""
    least = F.lit(lines.count()) < F.col("n_docs") * HOT_SHARE
    hot = F.broadcast(closed.where(least).select("hash"))
    rare = closed.where(~least).select("hash")
    return lines.join(hot, "hash", "left_semi").union(lines.join(hot, "hash", "left_anti").join(rare, "hash", "left_semi"))


_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _without_closed(docs: DataFrame, closed: DataFrame) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_kept, carried) by a broadcast set of closed hashes: texts stay where they are."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.hash) for r in closed.select("hash").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = known.value
        seen: dict[bytes, bool] = {}

        def stays(line: bytes) -> bool:
            if (found := seen.get(line)) is None:
                key = line.strip(BLANKS.encode()).translate(_TO_LOWER)
                found = not key or hashlib.md5(key).digest() not in bad
                if len(line) < 256:
                    if len(seen) >= 1 << 16:
                        seen.clear()
                    seen[line] = found
            return found

        for batch in batches:
            texts, sizes, kept = [], [], []
            for text in batch.column("text"):
                lines = text.as_buffer().to_pybytes().split(b"\n")
                keep = [x for x in lines if stays(x)]
                texts.append(b"\n".join(keep))
                sizes.append(len(lines))
                kept.append(len(keep))
            columns = [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64()), batch.column("carried")]
            yield pa.record_batch(columns, names=["doc_id", "kept_text", "n_lines", "n_kept", "carried"])

    carried = docs.schema["carried"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id long, kept_text string, n_lines long, n_kept long, carried {carried}")


def _joined_without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The same by joining each text with its closed hashes."""
    joined = docs.join(bad.groupBy("doc_id").agg(F.collect_set("hash").alias("bad")), "doc_id", "left").withColumn("lines", F.split("text", "\n", -1))
    keep = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: F.coalesce(~F.array_contains("bad", key_hash(x)), F.lit(True))))
    kept = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), keep.alias("keep"), "carried")
    return kept.select("doc_id", F.array_join("keep", "\n").alias("kept_text"), "n_lines", F.size("keep").cast("long").alias("n_kept"), "carried")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) and the columns in carry, a row for each row of docs.

    A text is split at \\n; lines whose key (blanks stripped, A-Z lower-cased) has at least one code point and is found in at
    least min_docs documents lose all their lines, the first ones too. A null text is an empty one, which has one empty line;
    empty lines always stay. Null doc_ids are together one document. Rows that repeat a doc_id count as one document and each
    of them is returned. Other columns are not read. Up to MOST_BROADCAST closed hashes are broadcast, so that texts aren't
    shuffled; where there are more, each text is joined with its own, with the same result.
    """
    docs = docs.select(id_or_lowest().alias("doc_id"), text_or_empty().alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    runs, lines = feed_lines(docs, min_docs, batches, fanout)
    closed = runs.closed()
    if closed.count() <= MOST_BROADCAST:
        kept = _without_closed(docs, closed)
    else:
        kept = _joined_without(docs, frequent_lines(closed, lines))
    return kept.select(
        null_if_lowest(F.col("doc_id")).alias("doc_id"), "kept_text", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_dropped"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id
"""

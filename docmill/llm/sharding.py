"""Sharding by sampled splitters: near-equal bytes, range by range, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import id_or_lowest, materialize, null_if_lowest, text_or_empty

#: A splitter (k, id): the range below it holds the keys up to it, itself excluded. NO_ID: before every id of its k.
NO_ID = -(2**63)


def _uniform(*columns: str | Column) -> Column:
    """A number from 0 to 1 that a hash of the columns fixes, so that a task that runs again draws the same sample."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**53)) / F.lit(float(2**53))


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below (k, id)."""
    out = F.lit(0)
    for block in (splitters[i : i + 64] for i in range(0, len(splitters), 64)):
        keys = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(i).cast("long").alias("id")) for k, i in block])
        out = out + F.size(F.filter(keys, lambda s: s <= F.struct(F.col("k"), F.col("id"))))
    return out


def _sampled(rows: DataFrame, share: Column) -> list[tuple[int, int]]:
    """Keys drawn with a chance of `share`."""
    drawn = rows.where(_uniform("k", "id", F.lit(3)) < share)
    return [(r.k, NO_ID) for r in drawn.select("k").collect()]


def _sampled_inside(ranged: DataFrame, ranges: list[int], by_id: list[int], per_byte: float) -> dict[int, list[tuple[int, int]]]:
    """Keys drawn in proportion to the size inside all the ranges in one job, by range; in those of by_id, one text's, with the id."""
    inside = ranged.where(F.col("range").isin(ranges) & (_uniform("k", "id", F.lit(3)) < F.col("size") * F.lit(per_byte)))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in inside.select("range", "k", F.when(F.col("range").isin(by_id), F.col("id")).otherwise(F.lit(NO_ID)).alias("id")).collect():
        out.setdefault(r.range, []).append((r.k, r.id))
    return out


def _quantiles(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """n - 1 boundaries that cut the sorted sample into n equal parts; ties fall together."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def shard_documents(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 8, samples_per_range: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards near equal in bytes, each a contiguous range of the key.

    The key is (hash of the text, doc_id), so that equal texts stand together; size is the text's UTF-8 bytes plus 1 (null: 1).

    1. Draw keys with a chance in proportion to the size: about shards * ranges_per_shard * samples_per_range of them,
       however large the input is; that bounded sample is all that the driver sees.
    2. Its quantiles are the splitters of shards * ranges_per_shard ranges.
    3. Measure each range; draw again inside those over twice the target (inside one text's group by doc_id) and subdivide
       them, until none is left that can be divided.
    4. Running sums inside the ranges, over the known sizes of the ranges before, give each record's place in the whole;
       equal parts of it are the shards. The rule is the same for every record, so that a group of equal texts, whose records
       stand together, is divided where a shard ends, however large or small it is.

    A null doc_id sorts first. Rows that repeat a doc_id and text are records of their own. An empty table gives no rows.
    """
    rows = docs.select(
        id_or_lowest().alias("id"),
        F.xxhash64(text_or_empty()).alias("k"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    rows = materialize(rows, "shard-keys")  # 32 bytes a record; the texts are read once
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = shards * ranges_per_shard
    drawn = _sampled(rows, F.col("size") * F.lit(n * samples_per_range / max(total, 1)))
    splitters = _quantiles(drawn, n)
    target = max(total / n, 1)
    for _ in range(8):
        ranged = rows.withColumn("range", _range_of(splitters))
        sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"), F.count(F.lit(1)).alias("n"))
        over = sizes.where((F.col("bytes") > 2 * target) & (F.col("n") > 1)).collect()  # as many rows as ranges at most
        if not over:
            break
        keys = _sampled_inside(ranged, [r.range for r in over], [r.range for r in over if r.low == r.high], samples_per_range / target)
        more = {x for r in over for x in _quantiles(keys.get(r.range, []), round(r.bytes / target))}
        if more <= set(splitters):
            break
        splitters = sorted({*splitters, *more})
    return _placed(rows.withColumn("range", _range_of(splitters)), shards, total)


def _placed(ranged: DataFrame, shards: int, total: int) -> DataFrame:
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))  # a row for each range: bounded by the splitters
    starts = starts.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    order = W.partitionBy("range").orderBy("k", "id", "size", "text_crc32")
    at = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = ranged.withColumn("at", at).join(F.broadcast(starts), "range")
    place = F.col("start") + F.col("at")
    rows = rows.withColumn("shard", F.least(F.floor(place * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
    # the slot: the record's number inside (range, shard), after the records of that shard in the ranges before
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("range", "shard").orderBy("k", "id", "size", "text_crc32")).cast("long") - 1)
    counts = rows.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"))  # ranges + shards rows at most
    so_far = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("range", "shard", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("offset"))
    rows = rows.join(F.broadcast(counts), ["range", "shard"])
    return rows.select(null_if_lowest(F.col("id")).alias("doc_id"), "size", "text_crc32", "shard", (F.col("nth") + F.col("offset")).alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes docs as Parquet folders shard=0 ... in slot order, by the assignment of shard_documents.

    Every row is written once: a null doc_id finds its own rows, and rows that repeat a doc_id and text take the slots of these
    one by one. A column of docs called shard gives way to the assigned one.
    """
    size = (F.octet_length(text_or_empty()) + 1).cast("long")
    names = [c for c in docs.columns if c != "shard"]
    rows = docs.select(id_or_lowest().alias("_id"), size.alias("_size"), F.crc32(text_or_empty().cast("binary")).alias("_crc32"), F.struct(*names).alias("_row"))
    places = assigned.select(id_or_lowest().alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc32"), "shard", F.col("slot").alias("_slot"))
    same = W.partitionBy("_id", "_size", "_crc32")
    rows = rows.withColumn("_nth", F.row_number().over(same.orderBy(F.xxhash64("_row"))))
    places = places.withColumn("_nth", F.row_number().over(same.orderBy("shard", "_slot")))
    placed = rows.join(places, ["_id", "_size", "_crc32", "_nth"]).select("_row.*", "shard", "_slot")
    placed.repartition("shard").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

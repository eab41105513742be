"""Contiguous shards of nearly equal bytes, from prefix sums over partition totals."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .base import checkpointed, load, text_or_empty

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text): shards are contiguous in doc_id order.

    Only ids, sizes and checksums are sorted, never texts. Each sorted partition gives one row of totals, from which the
    driver makes offsets (its rows are the partitions, at most spark.sql.shuffle.partitions). A row belongs to the shard
    whose equal part of all bytes holds the row's middle byte. Null texts are empty; null ids come first; rows of equal
    id are ordered by checksum and size, and are interchangeable beyond that. Without rows the result is empty; shards
    may be empty when there are fewer rows than shards or a text is longer than a shard.
    """
    ship(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    kept = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = {r.part: (r.bytes, r.n) for r in kept.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    before, at, n = {}, 0, 0
    for part in sorted(totals):
        before[part] = (at, n)
        at, n = at + totals[part][0], n + totals[part][1]
    total = max(at, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, part = 0, 0, None
        for batch in batches:
            if batch.num_rows:
                if part is None:
                    part = batch["part"][0].as_py()
                    at, n = before[part]
                size = batch["size"].to_numpy()
                ends = at + np.cumsum(size)
                shard = np.minimum((2 * ends - size) * shards // (2 * total), shards - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["size"], batch["text_crc32"], pa.array(shard), pa.array(n + np.arange(len(size)))], ["doc_id", "size", "text_crc32", "shard", "place"])
                at, n = int(ends[-1]), n + len(size)

    placed = kept.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, place long")
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    starts = F.create_map(*[F.lit(x) for kv in sorted(first.items()) for x in kv]) if first else F.create_map(F.lit(-1), F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - starts[F.col("shard")]).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Writes docs as one folder of Parquet files for each shard, in slot order."""
    placed = assign_shards(docs, shards).select(F.col("doc_id").alias("_id"), "shard", "slot")
    joined = docs.join(placed, docs["doc_id"].eqNullSafe(placed["_id"])).drop("_id")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(load(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """CRC-32 of each byte (the reflected polynomial 0xEDB88320)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        out.append(c)
    return out


OP3_SQL = f"""
with b as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as bytes from documents),
r as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, y: xor(c >> 8, {_crc_table()}[(xor(c, y) & 255) + 1])), 4294967295) as text_crc32 from b),
s as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as ends, sum(size) over () as total, row_number() over (order by doc_id nulls first, text_crc32, size) as place from r),
p as (select *, least((2 * ends - size) * 24 // (2 * total), 23)::int as shard from s)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, null::int as grown_shard from p
"""

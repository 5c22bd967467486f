"""Contiguous shards of nearly equal bytes, from prefix sums of per-partition totals.

Documents are ordered by ``doc_id`` (ties by size, then checksum).  The order is cut
into ranges, one partition each; the totals of the partitions, one row each, give
the bytes and rows before every partition, and a running sum within the partition
gives them before every document.  A document goes to the shard in whose equal
share of all bytes its middle byte lies, so shards are contiguous and each cut is
off by at most half a document.  Only DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace

OVERHEAD = 16


def text_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    A null text has size ``overhead`` and checksum 0; an empty text the same.  Null
    ids come first.  Rows that are equal in every column are kept, each with a slot
    of its own.  Fewer documents than shards leave shards empty.  An empty table
    gives no rows.  Other columns are ignored.
    """
    rows = Workspace(docs.sparkSession)
    order = ["doc_id", "size", "text_crc32"]
    sized = docs.select(
        "doc_id",
        text_size(F.col("text"), overhead).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    # Written, so that the partition numbers hold in every later reading.
    ranged = rows.written(
        sized.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    )
    # One row per partition: a single window over them is bounded by their number.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(Window.partitionBy(F.lit(0))).alias("total"),
        )
    )
    within = Window.partitionBy("part").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.join(totals, "part").select(
        *order,
        "total",
        (F.col("bytes_before") + F.sum("size").over(running) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("position"),
    )
    shard = F.expr(f"least({shards - 1}, ((2 * start + size) * {shards}) div (2 * total))")
    placed = numbered.withColumn("shard", shard.cast("int"))
    first = placed.groupBy("shard").agg(F.min("position").alias("first_position"))
    return placed.join(first, "shard").select(
        *order, "shard", (F.col("position") - F.col("first_position")).alias("slot")
    )

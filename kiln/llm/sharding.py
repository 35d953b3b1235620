"""Contiguous shards of nearly equal bytes, cut at equal targets of global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Partitions of the prefix sums. They fix the global order, so their number is a parameter and never follows the data:
#: neither the table's size nor its files decide where a row goes.
PARTS = 4096


def shard(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, parts: int = PARTS
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of df.

    size: UTF-8 bytes of the text (null: none) plus 1. Rows have one global order: by partition (a hash of id and
    checksum), then id, checksum and size. Partition totals give each partition's offset, a running sum within it each
    row's; a row goes to the shard in which its middle byte falls, so shards are contiguous and differ by one row's size
    at most. slot counts a shard's rows from 0 without gaps. Null id: a row like any other, first in its partition.
    Repeated rows: one row each. Empty table: no rows. Equal texts have equal size and text_crc32. Empty and very long
    texts: as their bytes say. Other columns are not read.
    """
    text = C.null_safe_text(F.col(text_col))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = C.materialise(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))), "sizes")
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # `parts` rows
    offsets = offsets.select(
        "part",
        upto("part_bytes").alias("bytes_before"),
        upto("part_rows").alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size")
    run = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("run", run).withColumn(
        "rank", F.row_number().over(within) - 1
    ).join(F.broadcast(offsets), "part")
    placed = placed.withColumn(
        "start", F.col("bytes_before") + F.col("run")
    ).withColumn("row", F.col("rows_before") + F.col("rank"))
    middle = F.floor((2 * F.col("start") + F.col("size")) * shards / (2 * F.col("total")))
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot")
    )

"""Contiguous balanced shards from global byte-size prefix sums (operator 9, native).

Rows are put in the order of doc_id (nulls first, then checksum, size and input
position) by a range partitioning. Each partition's total is summed, the totals
are added up over the partitions, and each row's global prefix is its partition's
offset plus the running sum within the partition. The row goes to the shard in
whose equal share of all bytes its middle lies, so shards are contiguous in that
order and their sizes differ from the mean by at most the longest row.

A null text has no bytes; the size of a row is its UTF-8 bytes plus 16. Repeated
ids and repeated rows are rows like any other. An empty table gives no rows.
Input columns beside the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, quoted, spool

ROW_OVERHEAD = 16


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    sizes = spool(
        docs.select(
            F.col(quoted(id_col)).alias("doc_id"),
            (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "sizes",
    )
    order = ["doc_id", "text_crc32", "size", "rid"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = spool(sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(  # one row for each partition
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    middle = 2 * F.col("bytes_before") + 2 * F.sum("size").over(inside) - F.col("size")
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        middle.alias("middle"),
        "all_bytes",
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    share = F.expr(f"CAST(middle * {int(shards)} div (2 * all_bytes) AS INT)")
    placed = spool(placed.select("doc_id", "size", "text_crc32", share.alias("shard"), "place"), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )


def op9_byte_shards(spark, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir, "doc_id", "text"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: DuckDB has no CRC-32; the query is tested against a brute-force version.
ORACLE = None

"""Balanced contiguous shards by global byte-size prefix sums (DataFrame functions only).

Rows are put in the order of their id by a range partitioning.  The byte sizes of each partition
are summed, the sums are accumulated over the partitions, and every row learns the number of bytes
before it.  Shard ``s`` of ``n`` holds the rows whose middle byte lies in the s-th of ``n`` equal
pieces of the whole, so shards are contiguous in the order and differ by about one row's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prefix_sums, shuffle_width

#: Bytes that each row costs besides its text.
ROW_BYTES = 16


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_bytes: int = ROW_BYTES,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Cut ``docs`` into ``shards`` contiguous shards of nearly equal bytes (law ``bytes``).

    Returns the id, ``size`` (UTF-8 bytes of the text plus ``row_bytes``), ``text_crc32``, ``law``,
    ``shard`` (from 0), ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null under this
    law), then the columns named in ``carry``; other columns of ``docs`` are ignored, whatever their
    names.

    Cases: a null text has no bytes and a null checksum; an empty text has no bytes and checksum 0;
    a null id sorts first; repeated rows are all kept, one after the other; a text larger than a
    shard's target leaves neighbouring shards empty; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(row_bytes)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        size.alias("_size"),
        F.crc32(F.encode(F.col(text_col), "UTF-8")).alias("_crc"),
        *[F.col(c).alias(f"_carry_{k}") for k, c in enumerate(carry)],
    )
    # Without anything to carry, the texts are read once and what follows works on the few bytes kept of each; what is
    # carried moves once, into its range.  _row parts rows that are alike.
    rows = (rows if carry else checkpoint(rows)).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("_id", "_size", "_crc", "_row")]
    rows = checkpoint(
        rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    )
    summed = prefix_sums(rows, "_part", {"_bytes": F.col("_size"), "_place": F.lit(1)}, order)
    # twice the bytes up to the middle of the row, so that all stays integral
    middle = (F.col("_bytes") * 2 - F.col("_size")).cast("decimal(20,0)")
    cut = summed.withColumn("_middle", middle).withColumn(
        "_shard", F.least(F.lit(shards - 1), F.expr(f"_middle * {shards} div (_bytes_all * 2)")).cast("int")
    )
    first = cut.groupBy("_shard").agg(F.min("_place").alias("_first"))
    return cut.join(F.broadcast(first), "_shard").select(  # a row for each shard
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_place") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry_{k}").alias(c) for k, c in enumerate(carry)],
    )

"""Balanced contiguous shards from global prefix sums of byte sizes.

Rows are range-partitioned by their order key and laid down with the number of
their partition. Per-partition totals (one row per partition) give every
partition its global offset; a running sum inside the partition does the rest,
so no task sees more than its own range. Shard ``k`` takes the rows whose
middle byte lies in the k-th of ``shards`` equal stretches of all bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tracegraph.llm.common import fresh, land


def shard_by_bytes(docs: DataFrame, shards: int = 8, order: str = "doc_id", text: str = "text",
                   carry: Sequence[str] = ()) -> DataFrame:
    """Cut ``docs``, in the order of ``order``, into ``shards`` contiguous runs of nearly equal bytes.

    Returns ``order``, the columns of ``carry``, size (UTF-8 bytes plus 1; a null text has
    no bytes), text_crc32 (unsigned; of the empty text for null), shard (0 to ``shards`` - 1)
    and slot (0, 1, ... inside the shard).

    Null keys come first; rows with equal keys are ordered by checksum, and rows equal in that
    too by their place in the input. An empty table gives an empty result; a shard can be empty where one
    row is larger than a shard's share. Columns outside ``order``, ``text`` and ``carry``
    are never read, so their names cannot clash; a carried column keeps its name, and a column of the result that is called so gets a longer one.
    """
    named = lambda c: fresh([order, *carry], c)
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    src = docs.select(
        F.monotonically_increasing_id().alias("seq"), F.col(f"`{order}`").alias("key"), (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"))
    if carry:
        src = land(src, "carried")  # the wide rows stay where they are until their places are known
    ranged = src.drop("row").repartitionByRange("key", "text_crc32", "seq").withColumn("part", F.spark_partition_id())
    laid = land(ranged, "byte-ranges")

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = laid.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    running = W.partitionBy("part").orderBy("key", "text_crc32", "seq")
    end = F.sum("size").over(running.rowsBetween(W.unboundedPreceding, 0))
    # offsets: one row per partition of the range exchange, a bound set by the session
    placed = (
        laid.withColumns({"end": end, "nth": F.row_number().over(running)})
        .join(F.broadcast(offsets), "part")
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("end")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"middle2 * {shards} div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"))
        .withColumn("at", F.col("rows_before") + F.col("nth") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # at most `shards` rows
    out = placed.join(F.broadcast(first), "shard").select("seq", "key", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
    if carry:
        out = out.join(src.select("seq", "row"), "seq")
    return out.select(F.col("key").alias(order), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
                      *[F.col(c).alias(named(c)) for c in ("size", "text_crc32", "shard", "slot")])


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write every shard to a folder of its own, rows of a shard in slot order within each file; an empty table writes none."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Assigning documents to shards of nearly equal bytes, equal texts together.

Texts are dealt to ``SLICES`` slices by their digest, so a group of equal texts
always lies within one slice.  Slices, in order, are the atoms of a contiguous
minimax partition: the smallest capacity that suffices is found by binary search
with a greedy check.  The number of slices is fixed, so the sizes on the driver
do not grow with the corpus, and a slice of a large corpus holds less than
0.002 % of it, unless one text's copies alone are more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import cut_lineage

SLICES = 1 << 16

#: Parts of a slice, by document, that are numbered apart, so that a slice full of copies spreads over tasks.
PARTS = 64


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which ``sizes``, in order, fit ``shards`` contiguous shards."""
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        return at == len(sizes)

    total, largest = int(ends[-1]), int(max(sizes, default=0))
    low = max(-(-total // shards), largest)
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def cut_slices(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every slice: contiguous, none above the smallest capacity, each as near to an even share of the rest as that allows."""
    capacity = smallest_capacity(sizes, shards)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    earliest = [len(sizes)]  # where the last i shards may begin at the earliest
    for _ in range(shards):
        earliest.append(int(np.searchsorted(ends, ends[earliest[-1]] - capacity, side="left")))
    shard = np.zeros(len(sizes), dtype=np.int64)
    at = 0
    for i in range(shards):
        left = shards - i
        if left == 1:
            stop = len(sizes)
        else:
            share = ends[at] + (ends[-1] - ends[at]) / left
            stop = int(np.searchsorted(ends, share))
            if stop > at and share - ends[stop - 1] < ends[min(stop, len(sizes))] - share:
                stop -= 1
            most = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
            stop = min(max(stop, earliest[left - 1], at), most)
        shard[at:stop] = i
        at = stop
    return shard


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for a null, plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def assign_shards(table: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot: one row per row of ``table``.

    Sizes of shards are nearly equal; equal texts share a shard, and nulls count
    as empty texts; slots number the rows of a shard from 0 without gaps.  Rows
    may repeat.  Fewer texts than shards leave shards empty.
    """
    spark = table.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = table.select(
        F.col(f"`{key}`"),
        text_size(F.col(f"`{text}`")).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.conv(F.substring(F.md5(body), 1, 4), 16, 10).cast("int").alias("_slice"),
    ).withColumn("_part", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(PARTS)).cast("int"))
    slim = cut_lineage(slim)
    sums = slim.groupBy("_slice").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toPandas()
    sizes, counts = np.zeros(SLICES, dtype=np.int64), np.zeros(SLICES, dtype=np.int64)
    sizes[sums["_slice"]], counts[sums["_slice"]] = sums["size"], sums["n"]
    shard = cut_slices(sizes, shards)
    before = np.cumsum(counts) - counts
    first = np.array([before[np.searchsorted(shard, s)] if s in shard else 0 for s in range(shards)], dtype=np.int64)
    plan = pd.DataFrame({"_slice": np.arange(SLICES, dtype=np.int32), "shard": shard.astype(np.int32), "_start": before - first[shard]})
    plan = plan[counts > 0] if counts.any() else plan[:0]
    planned = spark.createDataFrame(plan, "_slice int, shard int, _start long")

    parts = slim.groupBy("_slice", "_part").agg(F.count(F.lit(1)).alias("_n")).join(planned, "_slice")
    earlier = Window.partitionBy("_slice").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_slice", "_part").orderBy(F.col(f"`{key}`"), "text_crc32", "size"))
    return (
        slim.withColumn("_rank", rank - 1)
        .join(parts, ["_slice", "_part"])
        .select(F.col(f"`{key}`"), "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot"))
    )


def write_shards(table: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``table`` into one folder per shard, in the order of their slots.  The key must be unique."""
    rows = table.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)

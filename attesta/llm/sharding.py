"""Shards of nearly equal bytes: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import staged

ATOM_BITS = 16
ROW_BYTES = 16


def _shards_needed(prefix: np.ndarray, capacity: int, most: int) -> int:
    """Shards a greedy pass fills in order, or most + 1 when these do not suffice."""
    start, used = 0, 0
    while start < len(prefix) - 1:
        stop = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
        if stop == start or used == most:
            return most + 1
        start, used = stop, used + 1
    return used


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which ``shards`` contiguous shards hold all groups, by binary search."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    total, largest = int(prefix[-1]), int(sizes.max(initial=0))
    low, high = max(largest, -(-total // shards)), total
    while low < high:
        middle = (low + high) // 2
        if _shards_needed(prefix, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each group: contiguous, none over the smallest capacity, else as even as the order allows.

    Each cut is the group boundary nearest to an even share of what is left, among the
    boundaries that keep this shard and the ones after it within the capacity.
    """
    n = len(sizes)
    if n == 0:
        return np.empty(0, dtype=np.int32)
    capacity = smallest_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    earliest = [n] * (shards + 1)  # the first boundary after which i shards of this capacity suffice
    for i in range(1, shards + 1):
        earliest[i] = int(np.searchsorted(prefix, prefix[earliest[i - 1]] - capacity, side="left"))
    result, start = np.empty(n, dtype=np.int32), 0
    for shard in range(shards):
        left = shards - shard
        goal = prefix[start] + (prefix[n] - prefix[start]) / left
        stop = int(np.searchsorted(prefix, goal))
        if stop > start and goal - prefix[stop - 1] < prefix[min(stop, n)] - goal:
            stop -= 1
        most = int(np.searchsorted(prefix, prefix[start] + capacity, side="right")) - 1
        stop = n if left == 1 else max(start, earliest[left - 1], min(stop, most))
        result[start:stop] = shard
        start = stop
    return result


def shard_documents(docs: DataFrame, shards: int, id_: str = "doc_id", text: str = "text", atom_bits: int = ATOM_BITS) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text (0 for null) plus 16. Documents are ordered by a
    64-bit hash of the text; an atomic group is all of one hash prefix of ``atom_bits`` bits,
    so equal texts never part. The driver sees at most 2^atom_bits group sizes, whatever
    the table holds; a shard is off an even share by about one group. One group larger than a
    share fills a shard of its own. Slots number the rows of a shard from 0 without gaps, in
    the order of group and id; repeated rows get a slot each; null ids come first. A null
    text counts as the empty one (checksum 0). An empty table gives no rows; extra columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    atom = F.shiftrightunsigned(F.xxhash64(body), 64 - atom_bits)
    # runs of ids and salts bound what one task sorts, also where one group holds many rows
    row = F.monotonically_increasing_id()
    run = F.coalesce(F.floor(F.col(id_) / F.lit(4096)), F.pmod(row, F.lit(64)) - 64).cast("bigint")
    runs = staged(
        docs.select(
            F.col(id_).alias("id"),
            (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            atom.cast("bigint").alias("atom"),
            run.alias("run"),
            row.alias("place"),
        )
    )
    spark = docs.sparkSession
    atoms = sorted((r["atom"], r["bytes"]) for r in runs.groupBy("atom").agg(F.sum("size").alias("bytes")).collect())
    parts = cut(np.array([b for _, b in atoms], dtype=np.int64), shards)
    placed = spark.createDataFrame([(a, int(s)) for (a, _), s in zip(atoms, parts, strict=True)], "atom bigint, shard int")
    counts = runs.groupBy("atom", "run").agg(F.count("*").alias("n"))
    within_atom = Window.partitionBy("atom").orderBy(F.col("run").asc_nulls_first())
    before = counts.withColumn("below", F.sum("n").over(within_atom) - F.col("n"))
    atom_rows = before.groupBy("atom").agg(F.sum("n").alias("rows")).join(placed, "atom")
    # at most 2^atom_bits rows, so one task per shard
    over = Window.partitionBy("shard").orderBy("atom")
    offsets = atom_rows.select("atom", "shard", (F.sum("rows").over(over) - F.col("rows")).alias("offset"))
    starts = before.join(offsets, "atom").select("atom", "run", "shard", (F.col("offset") + F.col("below")).alias("first"))
    inside = Window.partitionBy("atom", "run").orderBy(F.col("id").asc_nulls_first(), "place")
    return (
        runs.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["atom", "run"])
        .select(F.col("id").alias(id_), "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("bigint").alias("slot"))
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_: str = "doc_id") -> None:
    """The documents as one folder per shard, each in slot order within its files; ids must be unique."""
    ordered = docs.join(placed.select(id_, "shard", "slot"), id_)
    ordered.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)

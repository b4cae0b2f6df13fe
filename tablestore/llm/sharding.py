"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (documents of equal text) are packed twice. First, parts of the groups are packed into crates of a fixed
capacity, each part in its own task. Then the crates, whose number is bounded by the capacity and the number of
parts and not by the rows, are packed into the shards on the driver. Both use best fit decreasing with a balanced
search tree over the remaining capacities.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablestore.llm.common import checkpoint, shuffle_partitions

#: Crates of a shard, about; more make the shards more equal.
CRATES = 256
#: Rows of a cell, about, until there are MAX_CELLS cells of groups: each leaves one crate that is not full.
CELL_ROWS = 20_000
MAX_CELLS = 65_536


class Capacities:
    """Remaining capacities in order, as a two-level B-tree: leaves of at most `width` entries under one root."""

    def __init__(self, width: int = 512):
        self.width, self.leaves, self.firsts = width, [[]], []

    def add(self, entry: tuple) -> None:
        i = max(0, bisect_left(self.firsts, entry) - 1) if self.firsts else 0
        leaf = self.leaves[i]
        insort(leaf, entry)
        if len(leaf) > self.width:
            half = len(leaf) // 2
            self.leaves[i:i + 1] = [leaf[:half], leaf[half:]]
            self.firsts[i:i + 1] = [leaf[0], leaf[half]]
        else:
            self.firsts[i:i + 1] = [leaf[0]]

    def take_at_least(self, size: int):
        """Remove and return the least entry whose capacity is at least `size`, or None."""
        if not self.firsts:
            return None
        probe = (size, -1)
        i = max(0, bisect_left(self.firsts, probe) - 1)
        for i in range(i, min(i + 2, len(self.leaves))):
            leaf = self.leaves[i]
            k = bisect_left(leaf, probe)
            if k < len(leaf):
                entry = leaf.pop(k)
                if leaf:
                    self.firsts[i] = leaf[0]
                elif len(self.leaves) > 1:
                    del self.leaves[i], self.firsts[i]
                else:
                    self.firsts = []
                return entry
        return None


def best_fit_decreasing(sizes: list[int], capacity: int, limit: int | None = None) -> list[int] | None:
    """The bin of each size, taken in the given (decreasing) order; a size above the capacity gets a bin of its own.

    With a limit, None as soon as more bins are needed.
    """
    free, out, bins = Capacities(), [], 0
    for s in sizes:
        entry = free.take_at_least(s)
        if entry is None:
            if limit is not None and bins >= limit or limit is not None and s > capacity:
                return None
            entry, bins = (max(capacity, s), bins), bins + 1
        out.append(entry[1])
        free.add((entry[0] - s, entry[1]))
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (any order): the least capacity, found by bisection, that needs no more shards."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    falling = [sizes[i] for i in order]
    low = max([-(-sum(falling) // shards), *falling[:1], 1])
    high = low
    while (found := best_fit_decreasing(falling, high, shards)) is None:
        low, high = high + 1, high + max(1, high // 50)
    best = found
    for _ in range(40):
        if low >= high:
            break
        mid = (low + high) // 2
        found = best_fit_decreasing(falling, mid, shards)
        if found is None:
            low = mid + 1
        else:
            best, high = found, mid
    out = [0] * len(sizes)
    for i, b in zip(order, best):
        out[i] = b
    return out


def shard(docs: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1. Null texts form one group, as do empty ones. A group is
    never split, so shards are as equal in bytes as the largest group lets them be: a group above the mean fills
    a shard of its own. slot numbers the rows of a shard from 0. Ties and repeated rows are ordered by
    id; which of two equal rows gets the lower slot does not matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.md5(F.col(text)))
    rows = docs.select(F.col(id).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), key.alias("key"))
    rows = checkpoint(rows)
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return rows.select(F.col("id").alias(id), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cells = min(-(-n // CELL_ROWS), MAX_CELLS)
    capacity = max(1, total // (shards * CRATES))

    def crates(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("size", "descending"), ("key", "ascending")])
        bins = best_fit_decreasing(part["size"].to_pylist(), capacity)
        base = key[0].as_py() << 32
        return pa.table({"key": part["key"], "size": part["size"], "crate": pa.array([base + b for b in bins], pa.int64())})

    packed = groups.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells))).repartition(max(shuffle_partitions(spark), cells // 4), "cell").groupBy("cell").applyInArrow(crates, "key string, size long, crate long")
    packed = checkpoint(packed)
    # at most 2 * total / capacity + cells crates: two crates of a cell are never both less than half full
    sums = packed.groupBy("crate").agg(F.sum("size").alias("size")).orderBy("crate").toArrow()
    ids, sizes = sums["crate"].to_pylist(), sums["size"].to_pylist()
    where = spark.createDataFrame(pa.table({"crate": pa.array(ids, pa.int64()), "shard": pa.array(pack(sizes, shards), pa.int32())}))
    of_key = packed.join(F.broadcast(where), "crate").select("key", "shard")
    placed = rows.join(of_key, "key").select("id", "size", "text_crc32", "shard")
    # ranks in two levels: cells of a shard, then rows of a cell
    parts = max(shuffle_partitions(spark), -(-n // CELL_ROWS))
    placed = checkpoint(placed.withColumn("cell", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(parts)).cast("int")))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "cell", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "text_crc32", "size")) - 1
    out = placed.withColumn("rank", rank).join(offsets, ["shard", "cell"])
    return out.select(F.col("id").alias(id), "size", "text_crc32", "shard", (F.col("rank") + F.col("before")).cast("long").alias("slot"))

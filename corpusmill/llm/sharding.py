"""Shards of near-equal bytes: longest-processing-time scheduling of groups of equal texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def schedule(sizes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, how many groups), in falling order of size, how many groups each shard gets.

    Each group goes to the shard of least load, the lower number first, kept in a heap. Groups of one size are
    alike: a shard takes several at once while it stays the least, and when no two loads differ by as much as the
    size, whole rounds are dealt at once, for then each round gives each shard one.
    """
    heap = [(0, k) for k in range(shards)]
    for size, left in sizes:
        given = [0] * shards
        while left:
            if left > shards and size > 0 and max(heap)[0] - heap[0][0] < size:
                rounds = left // shards
                heap = [(load + rounds * size, k) for load, k in heap]  # all by the same: still a heap
                given = [g + rounds for g in given]
                left -= rounds * shards
                continue
            load, k = heapq.heappop(heap)
            after, other = heap[0] if heap else (load + size * left, k)
            n = max(1, min(left, -(-(after - load) // size) if size else left))
            if n > 1 and (load + (n - 1) * size, k) > (after, other):
                n -= 1
            given[k] += n
            left -= n
            heapq.heappush(heap, (load + n * size, k))
        yield size, given


def _deal(shards: int):
    def run(batches):
        def rows():
            for pdf in batches:
                yield from zip(pdf["group_size"].tolist(), pdf["groups"].tolist(), strict=True)

        made = []
        for size, given in schedule(rows(), shards):
            ends, at = [], 0
            for g in given:
                at += g
                ends.append(at)
            made.append((size, ends))
            if len(made) == 10_000:
                yield pd.DataFrame(made, columns=["group_size", "ends"])
                made = []
        if made:
            yield pd.DataFrame(made, columns=["group_size", "ends"])

    return run


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows of equal text are a group and share a shard; null counts as the empty text. Groups are summed first (the
    copies of a text meet as partial sums), and only the number of groups of each total size goes to the scheduler:
    one task that streams distinct sizes in falling order and holds a heap of ``shards`` entries. Which of the
    groups of one size go to which shard follows an MD5 of the text. Slots are dealt by ``shared.ranked``, so no
    shard is sorted by one task. The table is read once; what is cut holds no text. An empty table gives no rows; repeated rows get slots of their own.
    """
    shared.ship(docs.sparkSession)
    rows = shared.cut(shared.columns_only(docs, "doc_id", "text").select(
        "doc_id",
        (shared.bytes_of(F.col("text")) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"),
    ))
    groups = shared.cut(rows.groupBy("key").agg(F.sum("size").alias("group_size")).withColumn("h", F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint")))
    dealt = (
        groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("groups"))
        .repartition(1).sortWithinPartitions(F.desc("group_size"))
        .mapInPandas(_deal(shards), "group_size long, ends array<long>")
    )
    placed = shared.ranked(groups, ["group_size"], "h", ["key"]).join(dealt, "group_size")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    out = shared.cut(rows.join(placed.select("key", shard), "key").withColumn("h", shared.order_hash(F.col("doc_id"), F.col("key"))))
    return shared.ranked(out, ["shard"], "h", ["doc_id", "key"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

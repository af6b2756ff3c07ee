"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

A partial partition is a tuple of shard sums. It starts with one group in one shard.
The two partial partitions with the largest spread are combined again and again, the
largest sum of one on the smallest of the other, until one is left. The groups that
weigh on the whole, a bounded number, are differenced first. All others are differenced
in slices side by side; each slice starts with its part of what the large groups left
uneven as one more tuple, which also says what shard a slot of the slice is.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from martwright.llm.common import dealt, stored

# Groups of a slice; a group is large if it holds more than this part of all bytes.
SLICE_GROUPS, MOST_LARGE = 50_000, 65_536
# monotonically_increasing_id: partition above, position in the partition below.
_BITS = 33


def difference(tuples: np.ndarray) -> np.ndarray:
    """Shard of every slot of every tuple (rows) of sums, by repeated differencing.

    Rows may be in any order; the result has their shape. Ties are settled by position.
    """
    count, shards = tuples.shape
    first = np.argsort(tuples, axis=1, kind="stable")
    sums = np.take_along_axis(tuples, first, axis=1).tolist()
    heap = [(row[0] - row[-1], i) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        joined = [a + b for a, b in zip(sums[x], reversed(sums[y]))]
        sums[x] = sums[y] = None
        order = sorted(range(shards), key=joined.__getitem__)
        merged.append((x, y, order))
        sums.append([joined[i] for i in order])
        heapq.heappush(heap, (sums[-1][0] - sums[-1][-1], len(sums) - 1))
    final: list[list[int] | None] = [None] * len(sums)
    final[-1] = list(range(shards))
    for node in range(len(sums) - 1, count - 1, -1):
        x, y, order = merged[node - count]
        own, left, right = final[node], [0] * shards, [0] * shards
        for slot, at in enumerate(order):
            left[at] = right[shards - 1 - at] = own[slot]
        final[x], final[y], final[node] = left, right, None
    result = np.empty((count, shards), np.int32)
    np.put_along_axis(result, first, np.array(final[:count], np.int32), axis=1)
    return result


def _slice(part: pd.DataFrame, shards: int, uneven: list[int]) -> pd.DataFrame:
    """Shard of every group of a slice; ``uneven`` are sums that the shards have already."""
    part = part.sort_values(["bytes", "grp"], ascending=[False, True], kind="stable")
    tuples = np.zeros((len(part) + 1, shards), np.int64)
    tuples[0], tuples[1:, -1] = uneven, part["bytes"]
    placed = difference(tuples)
    shard = np.empty(shards, np.int32)
    shard[placed[0]] = np.arange(shards)
    return part.assign(shard=shard[placed[1:, -1]])[["grp", "shard", "bytes"]]


def shard_groups(groups: DataFrame, shards: int = 16, slice_groups: int = SLICE_GROUPS, most_large: int = MOST_LARGE) -> DataFrame:
    """Shard of every group: columns grp and shard, from grp (unique) and bytes.

    At most ``most_large`` groups are large, so the task that differences them is bounded,
    and so is a slice. What a slice leaves uneven, a few bytes, adds up over the slices.
    """
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    is_large = F.col("bytes") > F.lit(total // most_large)
    kinds = "grp string, shard int, bytes long"
    even = [0] * shards
    large = groups.where(is_large).groupBy(F.lit(0).alias("slice")).applyInPandas(lambda part: _slice(part, shards, even), kinds)
    large = stored(large, "large")
    held = {r["shard"]: r["bytes"] for r in large.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    slices = max(1, math.ceil(count / slice_groups))
    least = min(held.get(s, 0) for s in range(shards))
    uneven = [(held.get(s, 0) - least) // slices for s in range(shards)]
    rest = groups.where(~is_large).select("grp", "bytes", F.pmod(F.xxhash64("grp"), F.lit(slices)).alias("slice"))
    small = dealt(rest, "slice", least=2 * slices).groupBy("slice").applyInPandas(lambda part: _slice(part, shards, uneven), kinds)
    return large.select("grp", "shard").unionByName(stored(small, "small").select("grp", "shard"))


def shard_documents(docs: DataFrame, shards: int = 16, slice_groups: int = SLICE_GROUPS, most_large: int = MOST_LARGE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents with equal texts (those without one together) are a group and stay in one
    shard, so a group above the fair share makes its shard as large as itself. The law
    is ``bytes``: ``grown_shard`` is null. ``slot`` numbers the documents of a shard from
    0, by group and doc_id. A null text has size 1 and crc 0. Repeated rows are documents
    of their own; an empty table gives no rows; further columns are not looked at.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    group = F.coalesce(F.md5(text), F.lit("null"))
    sized = stored(docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"), group.alias("grp")), "sized")
    groups = stored(sized.groupBy("grp").agg(F.sum("size").alias("bytes")), "groups")
    found = sized.join(shard_groups(groups, shards, slice_groups, most_large), "grp")
    order = ["shard", "grp", "doc_id", "size"]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_place", _BITS)).withColumn("_at", F.col("_place").bitwiseAND(F.lit((1 << _BITS) - 1)))
    placed = stored(placed.drop("_place"), "placed")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

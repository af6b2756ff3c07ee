"""Steps that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.sources.tables import write_stable

# Characters that separate words; a word is a run of anything else.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps never recompute it."""
    return write_stable(df, label)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dealt(df: DataFrame, *keys: str, least: int = 0) -> DataFrame:
    """Hash-partitioned for work that takes long on few bytes.

    Adaptive execution would merge such groups by their size; a named number of
    partitions stays.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(width, least), *keys)


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free digest of all rows."""
    return tuple(df.select(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from every vertex that has an edge.

    ``edges`` has two long columns. Alternates large-star and small-star steps: every
    vertex hands its smallest neighbour to its larger, then to its smaller neighbours.
    Smallest neighbours are combined before the shuffle and joined back with one row
    per vertex, so a hub with a third of all edges is split by the skew join. Each
    round is a written table; nothing but a count and a digest reaches the driver.
    Returns columns ``vertex`` and ``root``.
    """
    a, b = edges.columns
    high, low = F.greatest(a, b).alias("vertex"), F.least(a, b).alias("root")
    now = stored(edges.where(F.col(a) != F.col(b)).select(high, low).distinct(), "edges")
    before = fingerprint(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("root").alias("vertex"), F.col("vertex").alias("root")))
        least = both.groupBy("vertex").agg(F.min("root").alias("least"))
        least = least.withColumn("least", F.least("least", "vertex"))
        large = both.where("root > vertex").join(least, "vertex").select(F.col("root").alias("vertex"), F.col("least").alias("root")).distinct()
        least = large.groupBy("vertex").agg(F.min("root").alias("least"))
        kept = least.select("vertex", F.col("least").alias("root"))
        moved = large.join(least, "vertex").where("root <> least").select(F.col("root").alias("vertex"), F.col("least").alias("root"))
        now = stored(kept.unionByName(moved).distinct(), "edges")
        after = fingerprint(now)
        if after == before:
            return now
        before = after
    raise ValueError(f"components did not settle in {most_rounds} rounds")


def forest(size: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root (smallest index of the component) of indices 0..size-1 under batches of pairs."""
    root = np.arange(size)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in pairs:
        left, right = root[left], root[right]
        apart = left != right
        if not apart.any():
            continue
        low, high = np.minimum(left[apart], right[apart]), np.maximum(left[apart], right[apart])
        for code in np.unique(low.astype(np.int64) * size + high):
            x, y = top(int(code // size)), top(int(code % size))
            if x != y:
                root[max(x, y)] = min(x, y)
        while not np.array_equal(root, flat := root[root]):
            root[:] = flat
    return root


def blocks(key: Column, rows: Column, most: int) -> Column:
    """Block pairs of a row: a group of ``rows`` rows is cut into blocks of about ``most``.

    A row goes to every pair (i <= j) with its own block in it, so any two rows of a
    group meet in exactly one pair, and no task holds more than two blocks. ``key`` is a
    hash of the row. Returns an array of structs (i, j, home).
    """
    parts = F.greatest(F.ceil(rows / F.lit(most)), F.lit(1)).cast("int")
    home = F.pmod(key, parts).cast("int")
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda other: F.struct(F.least(home, other).alias("i"), F.greatest(home, other).alias("j"), home.alias("home")),
    )


def slices(size: int, step: int) -> Iterator[slice]:
    return (slice(start, min(size, start + step)) for start in range(0, size, step))

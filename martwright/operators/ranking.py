"""Exact global numbering and tiling without a single-partition window.

``row_number() over (order by ...)`` and ``ntile`` without PARTITION BY pull the
whole table into one task. Numbering here range-partitions instead and adds a
per-partition offset; tiling only looks for the few boundary rows and compares
every row with them, which needs no shuffle of the table at all.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from martwright.functions.money import safe_ratio
from martwright.sources.tables import write_stable

# Rows that are sorted on the driver in the end, over all ranges together.
DIRECT_ROWS = 20_000
# Sort keys sampled per round to bracket the wanted ranks, over all ranges together.
SAMPLE_ROWS = 50_000
# Keys sampled instead where many times as many rows are left: sorted by Spark, only brackets leave it.
SPREAD_ROWS, TIMES_LEFT = 1_000_000, 2
# A table is cut down to the brackets once they hold at most half of its rows, and not below this size.
LEAST_CUT = 1_000_000
# What a range gets of both at least, however many ranks are wanted.
LEAST_DIRECT, LEAST_SAMPLED = 32, 64

# monotonically_increasing_id: partition above, position in the partition below.
_POSITION_BITS = 33
_POSITION_MASK = (1 << _POSITION_BITS) - 1


@dataclass(frozen=True)
class By:
    """A sort key. Nulls sort last in either direction."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.desc_nulls_last(self.column) if self.descending else F.asc_nulls_last(self.column)

    def equals(self, value: Column, row: Column | None = None) -> Column:
        return self.of(row).eqNullSafe(value)

    def of(self, row: Column | None) -> Column:
        return F.col(self.column) if row is None else row[self.column]

    def precedes(self, value: Column, row: Column | None = None) -> Column:
        """Whether a row's key sorts strictly before ``value``."""
        column = self.of(row)
        beyond = column > value if self.descending else column < value
        return F.when(value.isNull(), column.isNotNull()).otherwise(F.coalesce(beyond, F.lit(False)))


def _sort_keys(keys: list[str | By]) -> list[By]:
    return [k if isinstance(k, By) else By(k) for k in keys]


def precedes(keys: list[By], values: list[Column], row: Column | None = None) -> Column:
    """Whether a row, or a struct of its keys, sorts strictly before the key values."""
    before = keys[-1].precedes(values[-1], row)
    for key, value in list(zip(keys, values))[-2::-1]:
        before = key.precedes(value, row) | (key.equals(value, row) & before)
    return before


def _json(value: Any) -> Any:
    """A key value as JSON that Spark reads back as the same value."""
    if isinstance(value, dt.datetime):
        instant = value if value.tzinfo else value.astimezone()
        return instant.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return str(value)


class Splits:
    """Sorted split points as one literal, an array of key values.

    A row finds its range by halving the array, so that the plan and the generated code
    are the same for one split point and for a thousand, and the work per row grows
    with their logarithm.
    """

    def __init__(self, table: DataFrame, keys: list[By], points: list[tuple]):
        self.keys, self.size = keys, len(points)
        point = StructType([StructField(f"k{i}", table.schema[k.column].dataType) for i, k in enumerate(keys)])
        text = json.dumps([{f"k{i}": _json(v) for i, v in enumerate(values)} for values in points])
        self.points = F.from_json(F.lit(text), ArrayType(point), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"})

    def index(self, low: int = 0) -> Column:
        """``low`` plus the number of split points at or before the row."""
        if not self.size:
            return F.lit(low)
        steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(self.size.bit_length()))])

        def search(row: Column) -> Column:
            def halve(found: Column, step: Column) -> Column:
                point = F.get(self.points, found + step - 1)
                before = precedes(self.keys, [point[f"k{i}"] for i in range(len(self.keys))], row)
                return F.when(found + step > self.size, found).when(before, found).otherwise(found + step)

            return F.aggregate(steps, F.lit(0), halve)

        # A key may be computed, and a filter takes its expression in: once a row, not once a step.
        row = F.struct(*dict.fromkeys(k.column for k in self.keys))
        return F.get(F.transform(F.array(row), search), 0) + low

    def within(self, ranges: list[int]) -> Column:
        """Whether a row lies in one of the ranges; range i starts at split i - 1."""
        wanted = set(ranges)
        flags = "".join("1" if i in wanted else "0" for i in range(self.size + 1))
        return F.substr(F.lit(flags), self.index(1), F.lit(1)) == "1"


def global_row_number(df: DataFrame, keys: list[str | By], name: str = "row_number", folder: str | None = None) -> DataFrame:
    """Number the rows 1..N in key order.

    The table is range-partitioned and sorted by the keys and written once to the
    shared folder together with each row's position, so that a lost executor or a
    second read can not see other partition bounds. End ``keys`` with a unique
    column: it makes the numbers deterministic and lets a hot leading key spread
    over several partitions.
    """
    order = [k.order() for k in _sort_keys(keys)]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = write_stable(placed, "numbered", folder)
    part = F.shiftright("_place", _POSITION_BITS)
    sizes = {r["part"]: r["rows"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect()}
    starts, total = [], 0
    for index in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(index, 0)
    if not starts:
        return stored.withColumn(name, F.lit(None).cast("bigint")).drop("_place")
    offset = F.get(F.lit(starts).cast("array<bigint>"), part.cast("int"))
    number = offset + F.col("_place").bitwiseAND(F.lit(_POSITION_MASK)) + 1
    return stored.withColumn(name, number).drop("_place")


def order_statistics(
    df: DataFrame,
    keys: list[str | By],
    ranks: list[int],
    direct_rows: int = DIRECT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    rows: int | None = None,
    spread_rows: int = SPREAD_ROWS,
    least_cut: int = LEAST_CUT,
) -> dict[int, tuple]:
    """Key values of the rows at the given 1-based ranks.

    Every round brackets all wanted ranks with two sampled keys each and counts the
    rows between the brackets exactly. Only rows inside a bracket, a few percent, go
    on to the next round, until the brackets together are small enough to be sorted
    on the driver. A bracket that misses costs a round, not the result. Only the key columns
    are read, and of a large table later rounds read what is left of it, written anew.
    ``keys`` must identify a row.
    """
    keys = _sort_keys(keys)
    order, names = [k.order() for k in keys], [k.column for k in keys]
    table = df.select(*names)
    rows = table.count() if rows is None else rows
    wanted = sorted({r for r in ranks if 1 <= r <= rows})
    if not wanted:
        return {}
    splits: list[tuple] = []
    sizes, held = [rows], rows
    left, idle, attempt = rows + 1, 0, 0
    while True:
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        inside = [[r - start for r in wanted if start < r <= start + size] for start, size in zip(starts, sizes)]
        open_ranges = sum(1 for within in inside if within)
        small_enough = max(LEAST_DIRECT, direct_rows // max(1, open_ranges))
        large = [i for i, size in enumerate(sizes) if inside[i] and size > small_enough]
        budget = max(sample_rows, LEAST_SAMPLED * len(large))
        # Ranges that hold no more rows than a sample would take are fetched whole.
        if sum(sizes[i] for i in large) <= budget:
            break
        before, left = left, sum(sizes[i] for i in large)
        idle, attempt = idle + 1 if left == before else 0, attempt + 1
        if idle == 3:
            raise ValueError(f"sort keys {names} do not tell rows apart; add a unique column")
        bounds = Splits(table, keys, splits)
        here = table.where(bounds.within(large)) if splits else table
        part = here.withColumn("_range", bounds.index()).select("_range", *names)
        if left >= TIMES_LEFT * spread_rows:
            by_range = _spread_brackets(part.sample(spread_rows / left, seed=attempt), keys, sizes, inside)
        else:
            sampled: dict[int, list[tuple]] = {}
            for r in part.sample(budget / left, seed=attempt).orderBy(*order).collect():
                sampled.setdefault(r["_range"], []).append(tuple(r)[1:])
            by_range = {i: [found[p] for p in _brackets(len(found), sizes[i], inside[i])] for i, found in sampled.items()}
        cut: list[tuple] = []
        for index in range(len(sizes)):
            if index in large:
                for values in by_range.get(index, []):
                    if not cut or cut[-1] != values:
                        cut.append(values)
            if index < len(splits) and (not cut or cut[-1] != splits[index]):
                cut.append(splits[index])
        counted = here.groupBy(Splits(table, keys, cut).index().alias("_range")).count()
        new = {r["_range"]: r["count"] for r in counted.collect()}
        # Ranges outside the brackets keep their size; each still ends at its old split.
        ends = {values: i for i, values in enumerate(splits)}
        sizes_now, home = [], 0
        for index in range(len(cut) + 1):
            sizes_now.append(new.get(index, 0) if home in large else sizes[home])
            if index < len(cut) and cut[index] in ends:
                home = ends[cut[index]] + 1
        splits, sizes = cut, sizes_now
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        kept = [i for i, (start, size) in enumerate(zip(starts, sizes)) if any(start < r <= start + size for r in wanted)]
        if held >= least_cut and 2 * sum(sizes[i] for i in kept) <= held:
            held = sum(sizes[i] for i in kept)
            table = write_stable(table.where(Splits(table, keys, splits).within(kept)), "bracketed")
    small = [i for i in range(len(sizes)) if inside[i]]
    ordered = table.where(Splits(table, keys, splits).within(small)).orderBy(*order).collect()
    found, first = {}, 0
    for index in small:
        found.update({starts[index] + r: tuple(ordered[first + r - 1]) for r in inside[index]})
        first += sizes[index]
    return found


def _spread_brackets(sample: DataFrame, keys: list[By], sizes: list[int], inside: list[list[int]]) -> dict[int, list[tuple]]:
    """The bracketing keys per range from a sample that Spark sorts."""
    numbered = global_row_number(sample, ["_range", *keys], "_number")
    counts = {r["_range"]: r["count"] for r in numbered.groupBy("_range").count().collect()}
    wanted, first = {}, 0
    for home in sorted(counts):
        wanted.update({first + position + 1: home for position in _brackets(counts[home], sizes[home], inside[home])})
        first += counts[home]
    by_range: dict[int, list[tuple]] = {}
    picked = numbered.where(F.col("_number").isin(list(wanted))).select("_number", *[k.column for k in keys]).collect()
    for number, *values in sorted(map(tuple, picked), key=lambda r: r[0]):
        by_range.setdefault(wanted[number], []).append(tuple(values))
    return by_range


def _brackets(sampled: int, rows: int, ranks: list[int]) -> list[int]:
    """Positions in a sorted sample around the ranks, three deviations to either side."""
    reach = 3 * math.isqrt(sampled) // 2 + 1
    positions = set()
    for rank in ranks:
        middle = rank * sampled // rows
        positions |= {p for p in (middle - reach, middle + reach) if 0 < p < sampled}
    return sorted(positions or {sampled // 2} if sampled else positions)


def tile_ends(rows: int, tiles: int) -> list[int]:
    """Last rank of every tile but the final one; larger tiles come first."""
    size, larger = divmod(rows, tiles)
    ends = [tile * size + min(tile, larger) for tile in range(1, tiles)]
    return [end for end in ends if end < rows]


def global_ntile(
    df: DataFrame,
    tiles: int,
    keys: list[str | By],
    name: str = "ntile",
    rows: int | None = None,
    direct_rows: int = DIRECT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``ntile(tiles) over (order by keys)`` as comparisons with the boundary rows.

    ``df`` is read several times for the boundaries, so pass a stored table.
    ``keys`` must identify a row.
    """
    keys = _sort_keys(keys)
    rows = df.count() if rows is None else rows
    ends = tile_ends(rows, tiles)
    starts = [end + 1 for end in ends]
    values = order_statistics(df, keys, starts, direct_rows, sample_rows, rows)
    return df.withColumn(name, Splits(df, keys, [values[s] for s in starts]).index(1).cast("int"))


def rank_by(df: DataFrame, column: str, name: str, descending: bool = True) -> DataFrame:
    """Rank over a small aggregate (one row per category, month or the like)."""
    return df.withColumn(name, F.rank().over(Window.orderBy(By(column, descending).order())))


def running_total(df: DataFrame, partition: list[str], order: str, column: str, name: str) -> DataFrame:
    """Running sum by row within each partition of an aggregate."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(column).over(window))


def share_of_total(df: DataFrame, column: str, name: str, within: list[str] | None = None, scale: int = 2) -> DataFrame:
    """Percent of the sum over the whole aggregate, or over the ``within`` group."""
    total = F.sum(column).over(Window.partitionBy(*(within or [])))
    return df.withColumn(name, safe_ratio(F.col(column), total, scale, 100))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position in a list that is already limited."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))

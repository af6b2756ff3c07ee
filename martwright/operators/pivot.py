"""Cross tables with free choice of rows, columns and aggregator, and totals.

The long form holds one row per cell; total rows and columns carry ``Totals`` in
place of the summed-up attributes. ``pivot_table`` spreads one attribute into
columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from martwright.functions import money
from martwright.operators.medians import LEVEL, grouped_medians, marked_keys
from martwright.operators.ranking import global_row_number
from martwright.sources.tables import write_stable

TOTAL = "Totals"
VALUE = "value"

# Aggregators whose totals follow from the totals of their parts. Per name: the
# parts taken per cell, how parts of several cells combine, the final value.
Parts = dict[str, tuple[Column, Callable[[str], Column]]]


def _sum_parts(value: str) -> Parts:
    return {"s": (F.sum(value), F.sum)}


def _count_parts(_: str | None) -> Parts:
    return {"n": (F.count("*"), F.sum)}


def _average_parts(value: str) -> Parts:
    return {"s": (F.sum(value), F.sum), "n": (F.count(value), F.sum)}


def _ratio_parts(value: tuple[str, str]) -> Parts:
    return {"s": (F.sum(value[0]), F.sum), "d": (F.sum(value[1]), F.sum)}


def _variance_parts(value: str) -> Parts:
    exact = F.col(value).cast("decimal(18,4)")
    return {"n": (F.count(exact), F.sum), "s": (F.sum(exact), F.sum), "q": (F.sum(exact * exact), F.sum)}


def _variance() -> Column:
    n, s, q = (F.col(c).cast("double") for c in "nsq")
    return F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))


_COMBINABLE: dict[str, tuple[Callable, Callable[[], Column]]] = {
    "count": (_count_parts, lambda: F.col("n")),
    "sum": (_sum_parts, lambda: F.col("s")),
    "average": (_average_parts, lambda: money.safe_ratio(F.col("s"), F.col("n"), 6)),
    "min": (lambda v: {"m": (F.min(v), F.min)}, lambda: F.col("m")),
    "max": (lambda v: {"m": (F.max(v), F.max)}, lambda: F.col("m")),
    "sum_over_sum": (_ratio_parts, lambda: money.safe_ratio(F.col("s"), F.col("d"), 6)),
    "sample_variance": (_variance_parts, _variance),
    "sample_stdev": (_variance_parts, lambda: F.sqrt(_variance())),
}


def _whole_group(agg: str, value: str, order: str | None) -> Column:
    """Aggregators that have to see the values of a group, not parts of them."""
    makers = {
        "list_unique": lambda: F.array_sort(F.collect_set(value)),
        "first": lambda: F.min_by(value, order),
        "last": lambda: F.max_by(value, order),
    }
    if agg not in makers:
        raise ValueError(f"unknown aggregator {agg!r}")
    if agg in ("first", "last") and order is None:
        raise ValueError(f"{agg} needs an order column")
    return makers[agg]()


_WITHIN = {"total": (False, False), "row": (True, False), "column": (False, True)}
FRACTIONS = tuple(f"{kind}_of_{base}" for kind in ("fraction", "count_fraction") for base in _WITHIN)
AGGREGATORS = sorted([*_COMBINABLE, *FRACTIONS, "count_unique", "list_unique", "first", "last", "median"])


def _levels(rows: list[str], cols: list[str], totals: bool) -> list[list[str]]:
    """Attribute sets to group by: cells, row totals, column totals, grand total."""
    levels = [[*rows, *cols]]
    if totals:
        for level in (rows, cols, []):
            if level not in levels:
                levels.append(level)
    return levels


def _marked(df: DataFrame, keys: list[str], levels: list[list[str]], level: list[str]) -> DataFrame:
    return df.select(F.lit(levels.index(level)).alias(LEVEL), *marked_keys(keys, level, TOTAL), VALUE)


def pivot_long(
    df: DataFrame,
    rows: list[str],
    cols: list[str],
    agg: str = "count",
    value: str | tuple[str, str] | None = None,
    totals: bool = False,
    order: str | None = None,
) -> DataFrame:
    """One row per cell: the row and column attributes as text, then ``value``.

    Sums, counts, means, extremes, ratios and variances compute their totals from the
    cells, so the data is aggregated once and the totals cost next to nothing.
    """
    return _leveled(df, rows, cols, agg, value, totals, order).drop(LEVEL)


def _leveled(
    df: DataFrame, rows: list[str], cols: list[str], agg: str, value: str | tuple[str, str] | None, totals: bool, order: str | None
) -> DataFrame:
    """The long form with the level of each line."""
    keys = [*rows, *cols]
    levels = _levels(rows, cols, totals)
    if agg in FRACTIONS:
        kind, base = agg.split("_of_")
        cells = df.groupBy(*keys).agg((F.sum(value) if kind == "fraction" else F.count("*")).alias(VALUE))
        by_row, by_column = _WITHIN[base]
        return _fractions(cells, keys, levels, rows if by_row else cols if by_column else [])
    if agg in _COMBINABLE:
        make, final = _COMBINABLE[agg]
        parts = make(value)
        cells = df.groupBy(*keys).agg(*[part.alias(name) for name, (part, _) in parts.items()])
        pieces = []
        for level in levels:
            summed = cells if level == keys else cells.groupBy(*level).agg(*[combine(n).alias(n) for n, (_, combine) in parts.items()])
            pieces.append(_marked(summed.withColumn(VALUE, final()), keys, levels, level))
        return reduce(DataFrame.unionByName, pieces)
    if agg == "median":
        return grouped_medians(df, keys, levels, value, TOTAL).withColumnRenamed("value", VALUE)
    if agg == "count_unique":
        return _distinct_counts(df, keys, levels, value)
    # What only depends on which values occur looks at each of them once per cell.
    seen = df.select(*keys, value).distinct() if agg == "list_unique" else df
    measure = _whole_group(agg, value, order).alias(VALUE)
    return reduce(DataFrame.unionByName, [_marked(seen.groupBy(*level).agg(measure), keys, levels, level) for level in levels])


def unique_values(df: DataFrame, rows: list[str], cols: list[str], value: str) -> DataFrame:
    """The values that ``list_unique`` puts into one cell, a row each, however many they are."""
    return df.where(F.col(value).isNotNull()).select(*rows, *cols, F.col(value).alias(VALUE)).distinct()


def _fractions(cells: DataFrame, keys: list[str], levels: list[list[str]], within: list[str]) -> DataFrame:
    pieces = []
    for level in levels:
        summed = cells if level == keys else cells.groupBy(*level).agg(F.sum(VALUE).alias(VALUE))
        base = [k for k in within if k in level]
        if base:
            shared = summed.withColumn("_total", F.sum(VALUE).over(Window.partitionBy(*base)))
        else:
            grand = summed.agg(F.lit(1).alias("_one"), F.sum(VALUE).alias("_total"))
            shared = summed.withColumn("_one", F.lit(1)).join(F.broadcast(grand), "_one")
        pieces.append(_marked(shared.withColumn(VALUE, money.safe_ratio(F.col(VALUE), F.col("_total"), 6)), keys, levels, level))
    return reduce(DataFrame.unionByName, pieces)


def _distinct_counts(df: DataFrame, keys: list[str], levels: list[list[str]], value: str) -> DataFrame:
    """Distinct values per cell and total, as bitmaps that add up.

    The data is aggregated once, to the values each cell has. Every value gets a number,
    those of one cell next to each other, so that the bitmaps of a cell are few and
    full. The bitmaps of a total are those of its cells, or-ed.
    """
    seen = write_stable(df.select(*keys, F.col(value).alias("_v")).distinct(), "seen")
    first = [F.min(F.struct(*keys)).alias("_first")] if keys else [F.lit(0).alias("_first")]
    values = seen.where("_v is not null").groupBy("_v").agg(*first)
    places = [f"_p{i}" for i in range(len(keys))]
    values = values.select("_v", *[F.col("_first")[k].alias(p) for k, p in zip(keys, places)])
    codes = global_row_number(values, [*places, "_v"], "_code").select("_v", "_code")
    bits = seen.join(codes, "_v", "left").groupBy(*keys, F.bitmap_bucket_number("_code").alias("_bucket"))
    bits = write_stable(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_code")).alias("_bits")), "bitmaps")
    pieces = []
    for level in levels:
        merged = bits if level == keys else bits.groupBy(*level, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
        counted = merged.groupBy(*level).agg(F.sum(F.bitmap_count("_bits")).alias(VALUE))
        pieces.append(_marked(counted, keys, levels, level))
    return reduce(DataFrame.unionByName, pieces)


def pivot_table(
    df: DataFrame,
    rows: list[str],
    cols: list[str],
    agg: str = "count",
    value: str | tuple[str, str] | None = None,
    totals: bool = True,
    order: str | None = None,
    headings: list[str] | None = None,
) -> DataFrame:
    """Cross table: one line per row attributes, one column per heading.

    Give the ``headings`` to spare the pass that looks them up; a value outside them is
    an error, as the totals would contain it and no column would. With totals the last
    column and the line named ``Totals`` hold them. Headings are one-to-one: of several
    attributes they are joined by `` / ``, where a slash, a backslash or the name of
    the totals inside a value gets a backslash, and a missing value reads ``\\N``.
    """
    long = _leveled(df, rows, cols, agg, value, totals, order)
    if not cols:
        return long.drop(LEVEL)
    levels = _levels(rows, cols, totals)
    is_line = F.col(LEVEL).isin([n for n, level in enumerate(levels) if not set(rows) <= set(level)])
    is_column = F.col(LEVEL).isin([n for n, level in enumerate(levels) if not set(cols) <= set(level)])
    special = r"[\\/]" if len(cols) > 1 else r"\\"
    parts = [F.coalesce(F.regexp_replace(c, special, r"\\$0"), F.lit(r"\N")) for c in cols]
    name = F.concat_ws(" / ", *parts)
    name = F.when(name == TOTAL, F.lit("\\" + TOTAL)).otherwise(name)
    if headings is not None:
        unlisted = F.raise_error(F.concat(F.lit("no heading for the value "), name)).cast("string")
        name = F.when(name.isin(headings), name).otherwise(unlisted)
        headings = [*headings, TOTAL] if totals else headings
    marked = long.withColumn("_heading", F.when(is_column, TOTAL).otherwise(name)).withColumn("_line", is_line)
    return marked.groupBy(*rows, "_line").pivot("_heading", headings).agg(F.first(VALUE)).drop("_line")


# The preset cross tables.
PRESETS = {
    "revenue_by_category_month": {"rows": ["category"], "cols": ["order_month"], "agg": "sum", "value": "net_revenue"},
    "orders_by_age_payment": {"rows": ["age_group"], "cols": ["payment_method"], "agg": "count", "value": None},
    "margin_by_category": {"rows": ["category", "subcategory"], "cols": [], "agg": "average", "value": "margin_pct"},
    "clv_by_city": {"rows": ["city"], "cols": ["age_group"], "agg": "sum", "value": "net_revenue"},
}


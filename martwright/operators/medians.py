"""Exact medians of all cells and totals of a cross table at once.

Every round counts rows per cell and range of values; the counts of totals follow from
those of cells. In each group the range that holds the middle is found from the counts
alone, and only rows in such a range go on, with finer ranges. No group is ever sorted or
gathered, and no row is repeated for the totals it belongs to. The data is read once, to
its keys and values; the range of a row follows from its value by arithmetic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from martwright.functions import money
from martwright.sources.tables import write_stable

# Position of a line's attribute set among the levels: tells totals from values.
LEVEL = "_level"

# Ranges that a range is cut into per round; the first ones are a quarter of these for every doubling of a value.
RANGES = 1024
# More than the logarithm to base 2 of any number, and than what is below one of any.
WIDEST = 1100
# A range with no more rows than this is counted value by value.
FEW = 4096


def marked_keys(keys: list[str], level: list[str], total: str) -> list[Column]:
    """The attributes of a level as text; those it sums over carry the name of the totals."""
    return [F.col(k).cast("string").alias(k) if k in level else F.lit(total).alias(k) for k in keys]


def _same(left: list[Column], right: list[Column]) -> Column:
    return reduce(Column.__and__, [a.eqNullSafe(b) for a, b in zip(left, right)], F.lit(True))


def _first_range(value: Column) -> Column:
    """Number of a value's first range, which never falls as values grow; zero and the infinities have one each."""
    value, steps = value.cast("double"), max(1, RANGES // 4)
    far = F.floor(F.least(F.log2(F.abs(value)), F.lit(float(WIDEST))) * steps) + WIDEST * steps
    return F.when(value > 0, far).when(value < 0, -far).otherwise(0)


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    measures = [F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    return write_stable(rows.groupBy(*keys, "_parent", "_path").agg(*measures), "ranges")


def _ranges_per_group(counts: DataFrame, keys: list[str], levels: list[list[str]], total: str) -> DataFrame:
    """Counts per group of every level, range and subrange, from the counts of cells."""
    pieces = []
    for number, level in enumerate(levels):
        summed = counts.where("_n > 0").groupBy(*level, "_parent", "_path")
        summed = summed.agg(F.sum("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
        group = [k.alias(f"_k{i}") for i, k in enumerate(marked_keys(keys, level, total))]
        pieces.append(summed.select(F.lit(number).alias("_at"), *group, "_parent", F.struct("lo", "hi", "n", F.col("_path").alias("path")).alias("_range")))
    return reduce(DataFrame.unionByName, pieces)


def _step(targets: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The subrange that holds the wanted rank of each target, and the rank within it.

    A group has at most ``RANGES`` or ``FEW`` subranges, in the first round those that its
    values reach of a fixed number; they are looked through as an array.
    """
    here = [F.col(LEVEL), *[F.col(k) for k in keys], F.col("_path")]
    there = [F.col("_at"), *[F.col(f"_k{i}") for i in range(len(keys))], F.col("_parent")]
    met = targets.join(ranges, _same(here, there))
    listed = met.groupBy(LEVEL, *keys, "_wanted", "_rank").agg(F.array_sort(F.collect_list("_range")).alias("_list"))

    def pass_by(state: Column, subrange: Column) -> Column:
        further = state["looking"] & (state["left"] > subrange["n"])
        return F.struct(
            F.when(further, state["left"] - subrange["n"]).otherwise(state["left"]).alias("left"),
            F.when(further, state["at"] + 1).otherwise(state["at"]).alias("at"),
            further.alias("looking"),
        )

    start = F.struct(F.col("_rank").alias("left"), F.lit(0).alias("at"), F.lit(True).alias("looking"))
    found = listed.withColumn("_found", F.aggregate("_list", start, pass_by))
    hit = F.get("_list", F.col("_found.at"))
    picked = found.select(LEVEL, *keys, "_wanted", F.col("_found.left").alias("_rank"), hit.alias("_hit"))
    return picked.select(LEVEL, *keys, "_wanted", "_rank", *[F.col(f"_hit.{c}").alias(f"_{c}") for c in ("path", "lo", "hi", "n")])


def _finer(rows: DataFrame, cells: DataFrame, targets: DataFrame, keys: list[str], levels: list[list[str]], total: str) -> DataFrame:
    """Rows in a range that a cell or one of its totals still looks at, with their subranges."""
    looked = []
    for number, level in enumerate(levels):
        wanted = targets.where(F.col(LEVEL) == number).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_path").distinct()
        inside = _same([F.col(k).cast("string") for k in level], [F.col(f"_k{keys.index(k)}") for k in level])
        looked.append(cells.join(wanted, inside).select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("_path").alias("_in")))
    needed = reduce(DataFrame.unionByName, looked).distinct()
    spans = targets.groupBy("_path").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_n").alias("_n"))
    own = [*[F.col(k) for k in keys], F.col("_path")]
    kept = rows.join(needed, _same(own, [*[F.col(f"_c{i}") for i in range(len(keys))], F.col("_in")])).join(spans, "_path")
    if isinstance(rows.schema["_v"].dataType, DoubleType):  # halves: no overflow
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    else:
        part = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
    # A range of one value is found already: what is left of it beside others has no width.
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(part * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
    sub = F.when(F.col("_n") <= FEW, F.col("_v").cast("string")).otherwise(place.cast("string"))
    return kept.select(*keys, "_v", F.col("_path").alias("_parent"), F.concat_ws("/", "_path", sub).alias("_path"))


def grouped_medians(df: DataFrame, keys: list[str], levels: list[list[str]], value: str, total: str) -> DataFrame:
    """``LEVEL``, the keys as text and the exact median, per group of every level.

    ``levels`` are subsets of ``keys``. Nulls and NaN are no values; a group without any
    has a null median. The values of a first range differ by some thousandths, so where
    values are spread a second look concerns few rows; where they lie close together it
    concerns many, the third one a thousandth of them. A value that fills a range alone needs none.
    """
    kind, v = df.schema[value].dataType, F.col(value)
    if isinstance(kind, (FloatType, DoubleType)):
        v = F.when(~F.isnan(v), v).cast("double")
    elif isinstance(kind, IntegralType):
        v = v.cast("decimal(20,0)")
    source = df.select(*keys, v.alias("_v"))
    rows = write_stable(source, "placed")
    rows = rows.select("*", F.lit("").alias("_parent"), _first_range(F.col("_v")).cast("string").alias("_path"))
    counts = _counted(rows, keys)
    cells = counts.select(*keys).distinct()
    sizes = [
        counts.groupBy(*level).agg(F.sum("_n").alias("_all")).select(F.lit(number).alias(LEVEL), *marked_keys(keys, level, total), "_all")
        for number, level in enumerate(levels)
    ]
    groups = reduce(DataFrame.unionByName, sizes)
    middle = F.array_distinct(F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1))
    targets = groups.where("_all > 0").select(LEVEL, *keys, F.explode(middle).alias("_wanted"), F.lit("").alias("_path"))
    targets = targets.withColumn("_rank", F.col("_wanted"))
    found = []
    while True:
        looked = write_stable(_step(targets, _ranges_per_group(counts, keys, levels, total), keys), "targets")
        found.append(looked.where("_lo = _hi").select(LEVEL, *keys, F.col("_lo").alias("_v")))
        targets = looked.where("_lo <> _hi")
        paths = [r["_path"] for r in targets.select("_path").distinct().limit(RANGES + 1).collect()]
        if not paths:
            break
        if len(paths) <= RANGES:
            rows = rows.where(F.col("_path").isin(paths))
        rows = write_stable(_finer(rows.where("_v is not null"), cells, targets, keys, levels, total), "placed")
        counts = _counted(rows, keys)
    values = reduce(DataFrame.unionByName, found).withColumn("_v", F.col("_v").cast("double"))
    medians = values.groupBy(LEVEL, *keys).agg(money.settle((F.min("_v") + F.max("_v")) / 2, 6).alias("value"))
    nothing = groups.where("_all = 0").select(LEVEL, *keys, F.lit(None).cast(medians.schema["value"].dataType).alias("value"))
    return medians.unionByName(nothing)

"""Filters, top-k, paging, row caps and one-row results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from martwright.operators.ranking import By, precedes


def drop_null_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all key columns filled; the tests reach the scan as filters."""
    return df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def keep_positive(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c) > 0 for c in columns]))


def revenue_only(df: DataFrame, wanted: bool = True) -> DataFrame:
    """Rows of revenue orders; all rows when ``wanted`` is false."""
    return df.where("is_revenue_order") if wanted else df


def in_list(column: str, values: list) -> Column:
    return F.col(column).isin(*values)


def out_of_range(column: str, low, high) -> Column:
    return (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))


def cost_exceeds_retail(products: DataFrame) -> DataFrame:
    return products.where(F.col("base_cost") >= F.col("retail_price"))


def has_competitor(df: DataFrame, column: str = "avg_competitor_price") -> DataFrame:
    return df.where(F.col(column).isNotNull())


# Keys that one task counts. A table of mostly different keys gains nothing from counting before the shuffle.
KEYS_PER_TASK = 500_000


def by_key(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Rows dealt by key to tasks enough that each has few keys to hold, however many rows there are.

    Counting keys that hardly repeat would otherwise keep all keys of a split of the input
    in one task's memory; a key that does repeat takes one place there.
    """
    tasks = -(-rows // KEYS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def having_count(df: DataFrame, keys: list[str], at_least: int = 2) -> DataFrame:
    """Key groups with at least this many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= at_least)


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose shown cells contain the text in any letter case."""
    shown = F.concat_ws(" ", *[F.col(c).cast("string") for c in columns or df.columns])
    return df.where(F.lower(shown).contains(text.lower()))


def category_filter(df: DataFrame, value: str, column: str = "category") -> DataFrame:
    """Rows whose category contains the value; all rows for an empty value."""
    return df.where(F.col(column).contains(value)) if value else df


def _order(keys: list[str | By]) -> list[Column]:
    return [(k if isinstance(k, By) else By(k)).order() for k in keys]


def top_k(df: DataFrame, k: int, order: list[str | By], tie_breakers: list[str | By]) -> DataFrame:
    """First ``k`` rows; the tie breakers make the choice repeatable."""
    return df.orderBy(*_order([*order, *tie_breakers])).limit(k)


def order_for_display(df: DataFrame, order: list[str | By]) -> DataFrame:
    return df.orderBy(*_order(order))


def optional_limit(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows; 0 keeps all."""
    return df.limit(n) if n > 0 else df


def sample_rows(df: DataFrame, n: int, order: list[str | By]) -> DataFrame:
    """``n`` rows for a look at the data, the same ones every time."""
    return df.orderBy(*_order(order)).limit(n)


def cap(df: DataFrame, n: int = 500, inclusive: bool = False) -> tuple[DataFrame, bool]:
    """At most ``n`` rows and whether rows were cut off.

    The query runs once: ``n + 1`` rows come to the driver and go back as a local
    frame. ``inclusive`` also reports a result of exactly ``n`` rows as cut off.
    """
    taken = df.limit(n + 1).collect()
    truncated = len(taken) >= n if inclusive else len(taken) > n
    return df.sparkSession.createDataFrame(taken[:n], df.schema), truncated


def page(df: DataFrame, order: list[str | By], size: int, after: tuple | None = None) -> DataFrame:
    """Next ``size`` rows after the given key values.

    A page is found by its predecessor's last key, so a late page costs no more
    than the first one.
    """
    keys = [k if isinstance(k, By) else By(k) for k in order]
    if after is not None:
        beyond = ~_at_or_before(keys, [F.lit(v) for v in after])
        df = df.where(beyond)
    return df.orderBy(*[k.order() for k in keys]).limit(size)


def _at_or_before(keys: list[By], values: list[Column]) -> Column:
    same = reduce(Column.__and__, [k.equals(v) for k, v in zip(keys, values)])
    return precedes(keys, values) | same


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def one_row(*totals: DataFrame) -> DataFrame:
    """Put several one-row aggregates side by side without a cross join."""
    names = [c for t in totals for c in t.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), totals)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def to_records(df: DataFrame) -> list[dict]:
    """All rows as records for an API answer; ``cap`` first where the caller wants fewer."""
    return [row.asDict(recursive=True) for row in df.collect()]


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))

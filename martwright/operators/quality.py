"""Data-quality checks.

A check yields ``(check, table, column, failures, passed)``. Failures are counted as
follows: null rows, values that occur more than once, distinct values outside the
accepted list, child rows without a parent, rows breaking a rule. Nulls pass every
check but ``not_null``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.operators.joins import orphan_counts
from martwright.operators.rows import by_key
from martwright.sources.tables import collect_garbage, write_stable


def _result(failures: DataFrame, check: str, table: str, column: str) -> DataFrame:
    return failures.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        F.col("failures").cast("bigint").alias("failures"),
        (F.col("failures") == 0).alias("passed"),
    )


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def duplicated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once, with their row count."""
    known = df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("rows"))
    return known.where(F.col("rows") > 1)


def check_unique(df: DataFrame, table: str, *columns: str) -> DataFrame:
    failures = duplicated(df, list(columns)).agg(F.count("*").alias("failures"))
    return _result(failures, "unique", table, ", ".join(columns))


# Repeated digests that a task may hold at once; each takes some 32 bytes there.
HELD_DIGESTS = 1_000_000


def check_unique_columns(tables: list[tuple[DataFrame, str, list[str]]], folder: str | None = None) -> DataFrame:
    """``check_unique`` of many single columns, every table read together with the others."""
    return check_unique_cells([(df, [(table, c, F.col(c)) for c in columns]) for df, table, columns in tables], folder)


def check_unique_cells(frames: list[tuple[DataFrame, list[tuple[str, str, Column]]]], folder: str | None = None) -> DataFrame:
    """``check_unique`` of many cells (table, column, value), listed by the frame that has them.

    Only digests of eight bytes are shuffled: a value that repeats has a digest that does.
    They are written, and what goes on is the values of these digests alone, which are
    counted as they are, so that values that merely share a digest are told apart.
    """
    spark = frames[0][0].sparkSession
    tests = [(table, column) for _, cells in frames for table, column, _ in cells]
    digests = by_key(reduce(DataFrame.unionByName, _digests(frames)), ["digest"], _rows(frames, _columns))
    repeated = write_stable(digests.groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1").select("digest"), "repeated", folder)
    collect_garbage(spark)
    found = spark.createDataFrame([], "test int, failures bigint")
    if known := repeated.count():
        values = reduce(DataFrame.unionByName, _values(frames)).where("value is not null")
        # With more of them than fit, all values are counted.
        if known <= HELD_DIGESTS:
            values = values.join(F.broadcast(repeated), "digest", "left_semi")
        dealt = by_key(values.drop("digest"), ["test", "value"], _rows(frames, len))
        counts = dealt.groupBy("test", "value").agg(F.count("*").alias("rows"))
        found = counts.where("rows > 1").groupBy("test").agg(F.count("*").alias("failures"))
    return _listed(spark, [("unique", *test) for test in tests], found)


def _columns(cells: list[tuple[str, str, Column]]) -> int:
    return len({column for _, column, _ in cells})


def _rows(frames: list[tuple[DataFrame, list]], per_row: Callable[[list], int]) -> int:
    return sum(df.count() * per_row(cells) for df, cells in frames)


def _digest(frame: int, column: str, value: Column) -> Column:
    """Digest of a value among those of a column; cells of one frame with the same column share them."""
    return F.when(value.isNotNull(), F.xxhash64(F.lit(f"{frame} {column}"), value))


def _digests(frames: list[tuple[DataFrame, list[tuple[str, str, Column]]]]) -> list[DataFrame]:
    """The digests of each row, once where cells of a column agree."""
    parts = []
    for n, (df, cells) in enumerate(frames):
        taken: dict[str, list[Column]] = {}
        row = []
        for _, column, cell in cells:
            value, before = cell.cast("string"), taken.setdefault(column, [])
            digest = _digest(n, column, value)
            row.append(F.when(~reduce(Column.__or__, [value.eqNullSafe(b) for b in before]), digest) if before else digest)
            before.append(value)
        parts.append(df.select(F.explode(F.array(*row)).alias("digest")).where("digest is not null"))
    return parts


def _values(frames: list[tuple[DataFrame, list[tuple[str, str, Column]]]]) -> list[DataFrame]:
    """Number of the test, value and digest of all cells."""
    parts, number = [], 0
    for n, (df, cells) in enumerate(frames):
        row = []
        for _, column, cell in cells:
            value = cell.cast("string")
            row.append(F.struct(F.lit(number).alias("test"), value.alias("value"), _digest(n, column, value).alias("digest")))
            number += 1
        parts.append(df.select(F.explode(F.array(*row)).alias("cell")).select("cell.*"))
    return parts


def check_not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """All columns in one pass, one result row each."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("failures")) for c in columns]))
    return counts.select(rows.alias("r")).select(
        F.lit("not_null").alias("check"), F.lit(table).alias("table"), "r.column", "r.failures", (F.col("r.failures") == 0).alias("passed")
    )


def unaccepted(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list, with their row count."""
    outside = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return outside.groupBy(column).agg(F.count("*").alias("rows"))


def check_accepted(df: DataFrame, table: str, column: str, values: list) -> DataFrame:
    failures = unaccepted(df, column, values).agg(F.count("*").alias("failures"))
    return _result(failures, "accepted_values", table, column)


def unparented(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child values without a parent, with their row count."""
    return orphan_counts(child.where(F.col(child_col).isNotNull()), child_col, parent, parent_col)


def check_fk(child: DataFrame, table: str, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    missing = unparented(child, child_col, parent, parent_col)
    return _result(missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("failures")), "relationships", table, child_col)


def check_fk_columns(tables: list[tuple[DataFrame, str]], relations: list[tuple[str, str, str, str]]) -> DataFrame:
    """``check_fk`` of many relations (child table, column, parent table, column).

    Every table is read once, and its keys go on as child or parent of each relation it
    is in. One shuffle brings the two sides of all relations together; rows of a child key
    are added up before it, so a hot key is one row a task.
    """
    parts = []
    for df, name in tables:
        cells = [(n, c, 1, 0) for n, (child, c, _, _) in enumerate(relations) if child == name]
        cells += [(n, k, 0, 1) for n, (_, _, parent, k) in enumerate(relations) if parent == name]
        tagged = [F.struct(F.lit(n).alias("test"), F.col(c).cast("string").alias("value"), F.lit(child).alias("rows"), F.lit(parent).alias("parent")) for n, c, child, parent in cells]
        parts.append(df.select(F.explode(F.array(*tagged)).alias("cell")).select("cell.*"))
    keys = reduce(DataFrame.unionByName, parts).where("value is not null")
    met = keys.groupBy("test", "value").agg(F.sum("rows").alias("rows"), F.max("parent").alias("parent"))
    found = met.where("parent = 0").groupBy("test").agg(F.sum("rows").alias("failures"))
    listed = [("relationships", child, column) for child, column, _, _ in relations]
    return _listed(tables[0][0].sparkSession, listed, found)


def _listed(spark: SparkSession, tests: list[tuple[str, str, str]], found: DataFrame) -> DataFrame:
    """Result rows of numbered tests (check, table, column); those not found have no failures."""
    names = spark.createDataFrame([(n, *test) for n, test in enumerate(tests)], "test int, check string, table string, column string")
    failures = F.coalesce(F.col("failures"), F.lit(0)).cast("bigint")
    return names.join(found, "test", "left").select("check", "table", "column", failures.alias("failures"), (failures == 0).alias("passed"))


@dataclass(frozen=True)
class CellTest:
    """A test that looks at one row: the condition under which it fails, and the value then shown.

    ``by_value`` counts the distinct values that fail instead of the rows.
    """

    check: str
    table: str
    column: str
    fails: Column
    value: Column | None = None
    by_value: bool = False


def not_null_test(table: str, column: str, cell: Column | None = None, present: Column | None = None) -> CellTest:
    """``present`` tells which rows belong to the table, all unless given."""
    empty = (F.col(column) if cell is None else cell).isNull()
    return CellTest("not_null", table, column, empty if present is None else present & empty)


def accepted_test(table: str, column: str, values: list, cell: Column | None = None) -> CellTest:
    cell = F.col(column) if cell is None else cell
    return CellTest("accepted_values", table, column, cell.isNotNull() & ~cell.isin(*values), cell, True)


def failing_cells(frames: list[tuple[DataFrame, list[CellTest]]]) -> DataFrame:
    """Failing values with their row counts: test (its place in the list of all tests), value, rows.

    Tests are grouped by the frame they read: each is scanned once for all of them, and
    only cells that fail leave the scan.
    """
    parts, number = [], 0
    for df, tests in frames:
        cells = []
        for test in tests:
            value = F.lit(None).cast("string") if test.value is None else test.value.cast("string")
            cells.append(F.when(F.coalesce(test.fails, F.lit(False)), F.struct(F.lit(number).alias("test"), value.alias("value"))))
            number += 1
        parts.append(df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*"))
    return reduce(DataFrame.unionByName, parts).groupBy("test", "value").agg(F.count("*").alias("rows"))


def check_cells(frames: list[tuple[DataFrame, list[CellTest]]]) -> DataFrame:
    """Results of all row tests, a scan per frame."""
    tests = [test for _, own in frames for test in own]
    by_value = F.col("test").isin([n for n, test in enumerate(tests) if test.by_value])
    found = failing_cells(frames).groupBy("test").agg(F.sum(F.when(by_value, 1).otherwise(F.col("rows"))).alias("failures"))
    return _listed(frames[0][0].sparkSession, [(t.check, t.table, t.column) for t in tests], found)


def check_rule(df: DataFrame, table: str, name: str, broken: Column) -> DataFrame:
    """Rows for which the ``broken`` condition holds."""
    return _result(df.agg(F.count_if(broken).alias("failures")), "rule", table, name)


def check_grain(df: DataFrame, key: str) -> DataFrame:
    """Rows next to distinct keys."""
    return df.agg(F.count("*").alias("fct_rows"), F.countDistinct(key).alias("unique_items"))


def check_scrape(prices: DataFrame, table: str = "competitor_prices") -> DataFrame:
    """Empty names, prices that are not positive, repeated name and category."""
    return all_checks(
        check_rule(prices, table, "empty product_name", F.trim("product_name") == ""),
        check_rule(prices, table, "price not positive", F.col("competitor_price") <= 0),
        check_unique(prices, table, "product_name", "category"),
    )

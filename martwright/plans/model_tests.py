"""The declared column tests of raw tables, staging tables, marts and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martwright.operators import quality
from martwright.plans.warehouse import Warehouse

# Table -> columns that must be unique.
UNIQUE = {
    "raw_customers": ["customer_id"],
    "raw_products": ["product_id"],
    "raw_orders": ["order_id"],
    "raw_order_items": ["order_item_id"],
    "stg_customers": ["customer_id"],
    "stg_products": ["product_id"],
    "stg_orders": ["order_id"],
    "stg_order_items": ["order_item_id"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "product_id"],
    "fct_sales": ["order_item_id"],
    "daily_revenue_trends": ["order_date"],
    "customer_lifetime_value": ["customer_sk"],
}

# Table -> columns that must be filled.
NOT_NULL = {
    "raw_customers": ["customer_id", "email", "country"],
    "raw_products": ["product_id", "retail_price"],
    "raw_orders": ["order_id", "customer_id"],
    "raw_order_items": ["order_item_id", "order_id", "product_id"],
    "stg_customers": ["customer_id", "email"],
    "stg_products": ["product_id", "retail_price", "base_cost"],
    "stg_orders": ["order_id", "customer_id"],
    "stg_order_items": ["order_item_id", "order_id", "product_id", "quantity", "unit_price"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "product_id", "gross_margin_pct"],
    "fct_sales": ["order_item_id", "order_id", "customer_sk", "product_sk", "quantity", "net_revenue"],
    "daily_revenue_trends": ["order_date"],
    "customer_lifetime_value": ["customer_sk"],
    "top_product_categories": ["category"],
}

# Table, column and its accepted values.
ACCEPTED = [
    ("stg_customers", "gender", ["MALE", "FEMALE", "NON-BINARY"]),
    ("stg_customers", "age_group", ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]),
    ("stg_products", "price_tier", ["Budget", "Mid-range", "Premium", "Luxury"]),
    ("stg_orders", "order_status", ["Completed", "Shipped", "Processing", "Cancelled", "Returned"]),
    ("dim_customer", "region", ["North America", "Europe", "APAC", "Middle East", "Other"]),
    ("dim_customer", "customer_segment", ["New", "Regular", "Loyal"]),
    ("customer_lifetime_value", "clv_tier", ["Champions", "Loyal", "Potential Loyal", "Recent", "At Risk", "Hibernating"]),
]

# Child table, column, parent table, column.
RELATIONSHIPS = [
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("stg_order_items", "product_id", "stg_products", "product_id"),
    ("fct_sales", "customer_sk", "dim_customer", "customer_sk"),
    ("fct_sales", "product_sk", "dim_product", "product_sk"),
]


def _table(w: Warehouse, name: str) -> DataFrame:
    return getattr(w.raw, name.removeprefix("raw_")) if name.startswith("raw_") else getattr(w, name)


def unique_tests(w: Warehouse) -> DataFrame:
    """A raw table and what is staged of it share a frame."""
    frames: dict[str, tuple[DataFrame, list[tuple[str, str, Column]]]] = {}
    for table, columns in UNIQUE.items():
        source = table.removeprefix("raw_").removeprefix("stg_")
        joint = source in w.beside_raw
        _, cells = frames.setdefault(source if joint else table, (w.beside_raw[source] if joint else _table(w, table), []))
        part = "raw" if table.startswith("raw_") else "stg"
        cells += [(table, c, F.col(f"{part}.{c}" if joint else c)) for c in columns]
    return quality.check_unique_cells(list(frames.values()), w.folder)


def _frames(w: Warehouse, filled: bool = True, accepted: bool = True) -> list[tuple[DataFrame, list[quality.CellTest]]]:
    """The row tests by the frame that answers them: a raw table and what is staged of it share one."""
    listed = list(dict.fromkeys([*(NOT_NULL if filled else []), *(t for t, _, _ in ACCEPTED if accepted)]))
    frames: dict[str, tuple[DataFrame, list[quality.CellTest]]] = {}
    for table in listed:
        source = table.removeprefix("raw_").removeprefix("stg_")
        joint = source in w.beside_raw
        if joint and source not in frames:
            frames[source] = (w.beside_raw[source], [])
        df, tests = frames.setdefault(source if joint else table, (None if joint else _table(w, table), []))
        part = "raw" if table.startswith("raw_") else "stg"

        def cell(column: str) -> Column:
            return F.col(f"{part}.{column}") if joint else F.col(column)

        present = F.col(part).isNotNull() if joint else None
        if filled:
            tests += [quality.not_null_test(table, c, cell(c), present) for c in NOT_NULL.get(table, [])]
        if accepted:
            tests += [quality.accepted_test(table, c, values, cell(c)) for t, c, values in ACCEPTED if t == table]
    return list(frames.values())


def not_null_tests(w: Warehouse) -> DataFrame:
    return quality.check_cells(_frames(w, accepted=False))


def accepted_value_tests(w: Warehouse) -> DataFrame:
    return quality.check_cells(_frames(w, filled=False))


def row_tests(w: Warehouse) -> DataFrame:
    """All tests that look at one row, with one scan per raw table and mart."""
    return quality.check_cells(_frames(w))


def failing_values(w: Warehouse) -> DataFrame:
    """What the row tests found: check, table, column, value and its rows."""
    frames = _frames(w)
    names = [(n, t.check, t.table, t.column) for n, t in enumerate(t for _, own in frames for t in own)]
    listed = w.spark.createDataFrame(names, "test int, check string, table string, column string")
    return listed.join(quality.failing_cells(frames), "test").drop("test")


def relationship_tests(w: Warehouse) -> DataFrame:
    tables = list(dict.fromkeys(name for child, _, parent, _ in RELATIONSHIPS for name in (child, parent)))
    return quality.check_fk_columns([(_table(w, t), t) for t in tables], RELATIONSHIPS)


def model_tests(w: Warehouse) -> DataFrame:
    """Every declared test, one row each."""
    return quality.all_checks(unique_tests(w), row_tests(w), relationship_tests(w))

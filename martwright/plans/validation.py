"""Validation reports over the raw tables and the marts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from martwright.functions import money
from martwright.operators.joins import hot_keys, skew_join
from martwright.operators.ranking import share_of_total
from martwright.operators.rows import by_key, having_count, one_row
from martwright.plans.warehouse import Warehouse


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per critical column and the row count, in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    return df.agg(*nulls, F.count("*").alias("total_rows"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """All keys that occur more than once, with their row count."""
    keys = df.select(key)
    return having_count(by_key(keys, [key], keys.count()), [key])


def duplicate_keys(df: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """First keys that occur more than once."""
    return repeated_keys(df, key).orderBy(key).limit(limit)


def count_where(df: DataFrame, condition, name: str) -> DataFrame:
    return df.agg(F.count_if(condition).alias(name))


def cost_exceeds_retail(products: DataFrame) -> DataFrame:
    return count_where(products, F.col("base_cost") >= F.col("retail_price"), "cost_exceeds_retail")


def out_of_range_orders(orders: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    day = F.col("order_date")
    return count_where(orders, (day < F.lit(first)) | (day > F.lit(last)), "out_of_range_orders")


def invalid_quantity(items: DataFrame) -> DataFrame:
    return count_where(items, F.col("quantity") <= 0, "invalid_quantity")


def invalid_discount(items: DataFrame) -> DataFrame:
    return count_where(items, (F.col("discount") < 0) | (F.col("discount") > 1), "invalid_discount")


def category_revenue_staging(items: DataFrame, products: DataFrame) -> DataFrame:
    """Orders, gross revenue and mean price per category from the raw tables."""
    sold = items.groupBy("product_id", "order_id").agg(
        F.sum(money.gross_revenue(F.col("quantity"), F.col("unit_price"))).alias("gross"),
        F.sum("unit_price").alias("prices"),
        F.count("unit_price").alias("priced"),
    )
    described = products.select("product_id", "category")
    parts = skew_join(sold, described, "product_id", hot_keys(items, "product_id"), ["order_id"])
    sums = parts.groupBy("category").agg(
        F.countDistinct("order_id").alias("num_orders"), F.sum("gross").alias("gross_revenue"), F.sum("prices").alias("prices"), F.sum("priced").alias("priced")
    )
    return sums.select("category", "num_orders", "gross_revenue", money.safe_ratio(F.col("prices"), F.col("priced")).alias("avg_unit_price"))


def orders_by_month(orders: DataFrame) -> DataFrame:
    day = F.col("order_date")
    return orders.groupBy(F.month(day).alias("month_num"), F.date_format(day, "MMM").alias("month_name")).agg(
        F.count("*").alias("order_count")
    )


def distribution(df: DataFrame, column: str, name: str, share: bool = False) -> DataFrame:
    """Rows per value, with the percentage of all rows if wanted."""
    counts = df.groupBy(column).agg(F.count("*").alias(name))
    return share_of_total(counts, name, "pct") if share else counts


def count_distinct(df: DataFrame, keys: list[str], columns: list[str], approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct values per group, exact or as a sketch of bounded size."""
    counted = [
        (F.approx_count_distinct(c, rsd) if approx else F.countDistinct(c)).alias(f"distinct_{c}") for c in columns
    ]
    return df.groupBy(*keys).agg(*counted)


def revenue_sanity(fact: DataFrame) -> DataFrame:
    """Totals over completed orders."""
    return fact.where(F.col("order_status") == "Completed").agg(
        F.round(F.sum("net_revenue"), 2).alias("total_net_revenue"),
        money.mean(F.col("net_revenue"), 2).alias("avg_order_item_revenue"),
        F.round(F.sum("gross_profit"), 2).alias("total_gross_profit"),
        money.mean(F.col("margin_pct"), 2).alias("avg_margin_pct"),
    )


def dimension_coverage(w: Warehouse) -> DataFrame:
    """Customers and products sold next to those known."""
    return one_row(
        w.fct_sales.agg(F.countDistinct("customer_sk").alias("customers_in_fact")),
        w.dim_customer.agg(F.count("*").alias("total_dim_customers")),
        w.fct_sales.agg(F.countDistinct("product_sk").alias("products_in_fact")),
        w.dim_product.agg(F.count("*").alias("total_dim_products")),
    )

"""Cleaned staging tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from martwright.functions import labels, money
from martwright.sources.schemas import LOADED_AT


def _loaded(df: DataFrame) -> list[str]:
    return [LOADED_AT] if LOADED_AT in df.columns else []


def _trimmed(*names: str) -> list[Column]:
    return [F.trim(n).alias(n) for n in names]


def _filled(*names: str) -> Column:
    return reduce(Column.__and__, [F.col(n).isNotNull() for n in names])


def _positive(*names: str) -> Column:
    return reduce(Column.__and__, [F.coalesce(F.col(n) > 0, F.lit(False)) for n in names])


# Which raw rows a staging table keeps, and its columns.
Staged = tuple[Column, list[Column]]


def _table(raw: DataFrame, staged: Staged) -> DataFrame:
    keep, columns = staged
    return raw.where(keep).select(*columns, *_loaded(raw))


def beside_raw(raw: DataFrame, staged: Staged) -> DataFrame:
    """Every raw row as ``raw``, and as ``stg`` what becomes of it, null if it is not kept."""
    keep, columns = staged
    return raw.select(F.struct(*raw.columns).alias("raw"), F.when(keep, F.struct(*columns)).alias("stg"))


def customer_rows(as_of: dt.date) -> Staged:
    registered = F.col("registration_date").cast("date")
    return _filled("customer_id", "email", "registration_date"), [
        F.col("customer_id"),
        *_trimmed("full_name"),
        F.upper(F.trim("gender")).alias("gender"),
        F.lower(F.trim("email")).alias("email"),
        *_trimmed("city", "country"),
        registered.alias("registration_date"),
        F.year(registered).alias("registration_year"),
        *_trimmed("age_group"),
        F.datediff(F.lit(as_of), registered).alias("tenure_days"),
    ]


def stg_customers(customers: DataFrame, as_of: dt.date) -> DataFrame:
    """Trimmed customers with registration year and tenure in days on ``as_of``."""
    return _table(customers, customer_rows(as_of))


def product_rows() -> Staged:
    return _filled("product_id") & _positive("retail_price", "base_cost"), [
        F.col("product_id"),
        *_trimmed("category", "subcategory", "product_name"),
        F.col("retail_price").cast("decimal(10,2)").alias("retail_price"),
        F.col("base_cost").cast("decimal(10,2)").alias("base_cost"),
        *_trimmed("supplier_name"),
        money.margin_pct(F.col("retail_price"), F.col("base_cost")).alias("gross_margin_pct"),
        labels.price_tier(F.col("retail_price")).alias("price_tier"),
    ]


def stg_products(products: DataFrame) -> DataFrame:
    """Trimmed, priced products with margin and price tier."""
    return _table(products, product_rows())


def order_rows(trim_first: bool = False) -> Staged:
    day = F.col("order_date").cast("date")
    status = F.trim("order_status") if trim_first else F.col("order_status")
    return _filled("order_id", "customer_id", "order_date"), [
        F.col("order_id"),
        F.col("customer_id"),
        day.alias("order_date"),
        *_trimmed("payment_method", "order_status"),
        F.coalesce(status.isin(*labels.REVENUE_STATUSES), F.lit(False)).alias("is_revenue_order"),
        F.year(day).alias("order_year"),
        F.month(day).alias("order_month"),
        F.quarter(day).alias("order_quarter"),
    ]


def stg_orders(orders: DataFrame, trim_first: bool = False) -> DataFrame:
    """Orders with the revenue flag.

    The flag looks at the status as delivered, so a padded status is no revenue
    order; ``trim_first`` looks at the trimmed status instead.
    """
    return _table(orders, order_rows(trim_first))


def item_rows(clamp_revenue: bool = False) -> Staged:
    quantity = F.col("quantity").cast("int")
    price = F.col("unit_price").cast("decimal(10,2)")
    clamped = money.clamp(F.col("discount").cast("decimal(5,4)")).cast("decimal(5,4)")
    applied = clamped if clamp_revenue else F.col("discount")
    return _filled("order_item_id", "order_id", "product_id") & _positive("quantity", "unit_price"), [
        F.col("order_item_id"),
        F.col("order_id"),
        F.col("product_id"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        clamped.alias("discount"),
        money.gross_revenue(quantity, price).alias("gross_revenue"),
        money.net_revenue(quantity, price, applied.cast("decimal(5,4)")).alias("net_revenue"),
    ]


def stg_order_items(items: DataFrame, clamp_revenue: bool = False) -> DataFrame:
    """Order lines with gross and net revenue.

    The shown discount is limited to [0, 1]; revenue uses the discount as delivered
    unless ``clamp_revenue`` is set.
    """
    return _table(items, item_rows(clamp_revenue))

"""Typed schemas of the raw (staging) tables and of their files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

PRICE = DecimalType(10, 2)
DISCOUNT = DecimalType(5, 4)


def _table(required: str, **columns: DataType) -> StructType:
    needed = set(required.split())
    return StructType([StructField(name, kind, name not in needed) for name, kind in columns.items()])


CUSTOMERS = _table(
    "customer_id full_name email",
    customer_id=StringType(),
    full_name=StringType(),
    gender=StringType(),
    email=StringType(),
    city=StringType(),
    country=StringType(),
    registration_date=DateType(),
    age_group=StringType(),
)
PRODUCTS = _table(
    "product_id category product_name retail_price base_cost",
    product_id=StringType(),
    category=StringType(),
    subcategory=StringType(),
    product_name=StringType(),
    retail_price=PRICE,
    base_cost=PRICE,
    supplier_name=StringType(),
)
ORDERS = _table(
    "order_id customer_id order_date",
    order_id=StringType(),
    customer_id=StringType(),
    order_date=DateType(),
    payment_method=StringType(),
    order_status=StringType(),
)
ORDER_ITEMS = _table(
    "order_item_id order_id product_id quantity unit_price",
    order_item_id=StringType(),
    order_id=StringType(),
    product_id=StringType(),
    quantity=IntegerType(),
    unit_price=PRICE,
    discount=DISCOUNT,
)
COMPETITOR_PRICES = _table(
    "product_name",
    product_name=StringType(),
    category=StringType(),
    section=StringType(),
    competitor_price=PRICE,
    stock_status=StringType(),
    scraped_at=TimestampNTZType(),
    source=StringType(),
)

RAW_TABLES = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "competitor_prices": COMPETITOR_PRICES,
}

LOADED_AT = "_loaded_at"


def with_load_ts(df: DataFrame, name: str = LOADED_AT) -> DataFrame:
    return df.withColumn(name, F.current_timestamp().cast("timestamp_ntz"))


@dataclass(frozen=True)
class RawTables:
    """The five raw inputs."""

    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    competitor_prices: DataFrame

"""Star schema: dimensions and the sales fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.functions import labels, money
from martwright.functions.keys import date_key, surrogate_key
from martwright.functions.text import match_name, pack_text, unpack_text
from martwright.operators.joins import hot_keys, hot_values, skew_join
from martwright.operators.ranking import global_row_number
from martwright.sources.schemas import LOADED_AT



def dim_customer(customers: DataFrame, folder: str | None = None) -> DataFrame:
    """Customers numbered in id order, with segment and region."""
    described = customers.drop(LOADED_AT).select(
        "*",
        labels.tenure_segment(F.col("tenure_days")).alias("customer_segment"),
        labels.country_region(F.col("country")).alias("region"),
    )
    numbered = global_row_number(described, ["customer_id", "email", "full_name"], "customer_sk", folder)
    return numbered.select("customer_sk", *described.columns)


def competitor_averages(prices: DataFrame) -> DataFrame:
    """Mean competitor price per compared name; unnamed rows can not match."""
    named = prices.where(F.col("product_name").isNotNull())
    return named.groupBy(match_name(F.col("product_name")).alias("_name")).agg(
        money.mean(F.col("competitor_price"), 6).alias("avg_competitor_price")
    )


def attach_competitor(products: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join on the compared name; the averages hold one row per name."""
    named = products.withColumn("_name", match_name(F.col("product_name")))
    joined = skew_join(named, competitor_averages(prices), "_name", hot_keys(named, "_name"), ["product_id"], "left").drop("_name")
    gap = F.round(F.col("retail_price") - F.col("avg_competitor_price"), 2)
    return joined.withColumn("price_vs_competitor", gap)


def dim_product(products: DataFrame, prices: DataFrame, folder: str | None = None) -> DataFrame:
    """Products numbered in id order, with competitor prices."""
    described = attach_competitor(products.drop(LOADED_AT), prices)
    numbered = global_row_number(described, ["product_id", "product_name", "retail_price"], "product_sk", folder)
    return numbered.select("product_sk", *described.columns)


def date_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day, both ends included."""
    span = spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    return spine_between(span, "start", "end")


def spine_between(span: DataFrame, start: str, end: str) -> DataFrame:
    """Days between two date columns of a one-row frame, without gaps."""
    return span.select(F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date_actual"))


def date_attributes(spine: DataFrame, as_of: dt.date) -> DataFrame:
    """Calendar columns for a frame of ``date_actual``."""
    day = F.col("date_actual")
    quarter, month, year = F.quarter(day), F.month(day), F.year(day)
    return spine.select(
        date_key(day).alias("date_sk"),
        day,
        year.alias("year"),
        quarter.alias("quarter_of_year"),
        month.alias("month_of_year"),
        F.date_format(day, "MMM").alias("month_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofweek(day).alias("day_of_week"),
        F.date_format(day, "EEE").alias("day_name"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        labels.quarter_label(day).alias("quarter_label"),
        F.date_format(day, "MMM yyyy").alias("month_year_label"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        labels.is_weekend(day).alias("is_weekend"),
        (~labels.is_weekend(day)).alias("is_weekday"),
        F.lit(False).alias("is_holiday"),
        labels.season(day).alias("season"),
        year.alias("fiscal_year"),
        quarter.alias("fiscal_quarter"),
        labels.fiscal_label(day).alias("fiscal_label"),
        labels.relative_period(day, as_of).alias("relative_period"),
    )


def date_dim(spark: SparkSession, start: dt.date, end: dt.date, as_of: dt.date) -> DataFrame:
    return date_attributes(date_spine(spark, start, end), as_of)


def line_measures() -> dict[str, Column]:
    """Cost, profit, margin and competitor gap of a line joined to its product."""
    net = F.col("net_revenue")
    cost = F.col("quantity") * F.col("base_cost")
    return {
        "cogs": money.money(cost),
        "gross_profit": money.money(net - cost),
        "margin_pct": money.margin_pct(net, cost),
        "competitor_price": F.col("avg_competitor_price"),
        "price_delta": F.round(F.col("unit_price") - F.col("avg_competitor_price"), 2),
    }


# What a line takes along through the shuffles; everything else of the fact follows from it.
LINE = ["order_item_id", "order_id", "product_id", "quantity", "unit_price", "discount"]
# Holds any mean of prices of ten digits, in half the bytes of the type it has elsewhere.
NARROW = "decimal(18,6)"


def _net() -> Column:
    return money.net_revenue(F.col("quantity"), F.col("unit_price"), F.col("discount"))


def sale_lines(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    raw_items: DataFrame | None = None,
    raw_orders: DataFrame | None = None,
) -> DataFrame:
    """One row per order line with what the fact is derived from.

    Orders meet their customers first, so that the far larger lines are shuffled by
    order and by product only. Lines meet products before orders: what a product adds is
    narrower than what an order adds, and so is every line in the second shuffle. Hot
    customers, orders and products are looked up in row samples of the unfiltered tables
    and spread over several tasks.
    """
    hot_customers = hot_keys(orders if raw_orders is None else raw_orders, "customer_id")
    hot = hot_values(items if raw_items is None else raw_items, ["order_id", "product_id"])

    known = skew_join(orders.drop(LOADED_AT), customers.select("customer_sk", "customer_id"), "customer_id", hot_customers, ["order_id"])
    headers = known.select("order_id", "order_date", "payment_method", "order_status", "is_revenue_order", "customer_sk")
    costs = products.select("product_sk", "product_id", "base_cost", F.col("avg_competitor_price").cast(NARROW).alias("avg_competitor_price"))
    # The revenue is taken along only where it does not follow from the discount shown.
    other_net = F.when(F.col("net_revenue") != _net(), F.col("net_revenue")).alias("other_net")
    # The id of a line is wide and no key of these joins: it goes packed.
    lines = items.select(pack_text(F.col("order_item_id")).alias("order_item_id"), *LINE[1:], other_net)
    priced = skew_join(lines, costs, "product_id", hot["product_id"], ["order_item_id"]).drop("product_id")
    return skew_join(priced, headers, "order_id", hot["order_id"], ["order_item_id"], shuffled=True)


def fact_rows(lines: DataFrame) -> DataFrame:
    """The columns of the fact, row by row from its lines."""
    lines = lines.withColumns({"net_revenue": F.coalesce("other_net", _net()), "avg_competitor_price": F.col("avg_competitor_price").cast(money.RATE)})
    lines = lines.withColumns({"avg_competitor_price": F.round("avg_competitor_price", 6), "order_item_id": unpack_text(F.col("order_item_id"))})
    measures = line_measures()
    return with_sale_key(lines.select(
        "order_item_id",
        "order_id",
        date_key(F.col("order_date")).alias("order_date_sk"),
        "order_date",
        "customer_sk",
        "product_sk",
        "payment_method",
        "order_status",
        "is_revenue_order",
        "quantity",
        "unit_price",
        "discount",
        money.gross_revenue(F.col("quantity"), F.col("unit_price")).alias("gross_revenue"),
        "net_revenue",
        *[expression.alias(name) for name, expression in measures.items()],
    ))


def with_sale_key(rows: DataFrame) -> DataFrame:
    """The key of a sale first: a digest of the line's id, so it need not be stored beside it."""
    return rows.select(surrogate_key("order_item_id").alias("sale_sk"), *rows.columns)


def derived() -> dict[str, Column]:
    """Columns of a fact row that a step of arithmetic gives from others of it, so they need not be stored."""
    return {
        "order_date_sk": date_key(F.col("order_date")),
        "gross_revenue": money.gross_revenue(F.col("quantity"), F.col("unit_price")),
        "gross_profit": money.money(F.col("net_revenue") - F.col("cogs")),
        "price_delta": F.round(F.col("unit_price") - F.col("competitor_price"), 2),
    }


def from_stored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The fact from its stored columns, in the given order."""
    return with_sale_key(rows.withColumns(derived()).select(*[c for c in columns if c != "sale_sk"]))


def fct_sales(
    items: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    raw_items: DataFrame | None = None,
    raw_orders: DataFrame | None = None,
) -> DataFrame:
    """One row per order line with keys and measures."""
    return fact_rows(sale_lines(items, orders, customers, products, raw_items, raw_orders))

"""Answers to the catalogue of business questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from martwright.functions import money
from martwright.operators.ranking import By
from martwright.operators.rows import has_competitor, revenue_only, top_k
from martwright.plans import analytics
from martwright.plans.dashboards import customer_revenue, sums_by
from martwright.plans.warehouse import Warehouse


def ask_top_customers(w: Warehouse, k: int = 10) -> DataFrame:
    """Best customers by revenue."""
    totals = customer_revenue(w).withColumnRenamed("revenue", "total_revenue")
    return top_k(totals, k, [By("total_revenue", True)], ["full_name", "city", "age_group"])


def ask_monthly_trend(w: Warehouse) -> DataFrame:
    """One row per sales day with its month's revenue and growth."""
    shown = w.daily_revenue_trends.orderBy("order_date")
    return shown.select("month_name", "month", F.round("monthly_revenue", 2).alias("monthly_revenue"), "num_orders", "mom_growth_pct")


def ask_category_performance(w: Warehouse, k: int = 10) -> DataFrame:
    best = top_k(w.top_product_categories, k, ["revenue_rank"], ["category", "subcategory"])
    return best.select("category", "total_revenue", F.round("avg_margin_pct", 1).alias("avg_margin_pct"), "num_orders")


def ask_competitor_prices(w: Warehouse, k: int = 20) -> DataFrame:
    priced = has_competitor(w.dim_product)
    best = top_k(priced, k, [By("retail_price", True)], ["product_sk"])
    return best.select("product_name", "category", "retail_price", F.col("avg_competitor_price").alias("competitor_price"), "price_vs_competitor")


def ask_default_monthly(w: Warehouse) -> DataFrame:
    """Revenue and orders by calendar month, all years together, in the order of the year."""
    month = [F.date_format("order_date", "MMM").alias("month_name"), F.month("order_date").alias("_month")]
    sums = w.fct_sales.groupBy(*month).agg(
        F.round(F.sum("net_revenue"), 2).alias("total_revenue"), F.countDistinct("order_id").alias("total_orders")
    )
    return sums.orderBy("_month").drop("_month")


def _margins(w: Warehouse, keys: list[str]) -> DataFrame:
    sums = sums_by(w.fct_sales, "product_sk").join(w.dim_product.select("product_sk", *keys), "product_sk")
    totals = sums.groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    return totals.withColumn("margin_pct", money.safe_ratio(F.col("profit"), F.col("revenue"), 2, 100))


def highest_margin_categories(w: Warehouse) -> DataFrame:
    """Profit margin per category, best first."""
    return _margins(w, ["category"]).orderBy(By("margin_pct", True).order(), By("category").order())


def highest_margin_products(w: Warehouse, category: str, k: int = 10) -> DataFrame:
    """Products of one category with the best margin."""
    sold = _margins(w, ["product_id", "product_name", "category"]).where(F.col("category") == category)
    return top_k(sold, k, [By("margin_pct", True)], ["product_id"])


def revenue_by(w: Warehouse, attribute: str) -> DataFrame:
    """Revenue, profit and buyers per customer attribute."""
    sums = sums_by(w.fct_sales, "customer_sk").join(w.dim_customer.select("customer_sk", attribute), "customer_sk")
    return sums.groupBy(attribute).agg(
        F.sum("revenue").alias("total_revenue"), F.sum("profit").alias("total_profit"), F.count("*").alias("num_customers")
    )


def lapsed_customers(w: Warehouse, days: int = 90, only_revenue: bool = False) -> DataFrame:
    """Customers without an order of any status for at least this many days, or at all.

    ``only_revenue`` looks at revenue orders alone and leaves out customers without one.
    """
    shown = ["customer_id", "full_name", "email"]
    if only_revenue:
        lapsed = w.customer_lifetime_value.where(F.col("days_since_last_order") >= days)
        return lapsed.select(*shown, "last_order_date", "days_since_last_order", "total_revenue")
    last = w.stg_orders.groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"))
    revenue = w.customer_lifetime_value.select("customer_id", "total_revenue")
    since = F.date_diff(F.lit(w.as_of), F.col("last_order_date"))
    known = w.dim_customer.select(*shown).join(last, "customer_id", "left").join(revenue, "customer_id", "left")
    known = known.withColumn("days_since_last_order", since)
    lapsed = known.where(F.col("last_order_date").isNull() | (since >= days))
    return lapsed.select(*shown, "last_order_date", "days_since_last_order", "total_revenue")


def aov_by_payment_method(w: Warehouse) -> DataFrame:
    """Orders, revenue and average order value per payment method."""
    totals = w.fct_sales.groupBy("payment_method").agg(F.countDistinct("order_id").alias("num_orders"), F.sum("net_revenue").alias("revenue"))
    return totals.withColumn("aov", money.safe_ratio(F.col("revenue"), F.col("num_orders")))


def priced_above_competitor(w: Warehouse) -> DataFrame:
    dearer = w.dim_product.where(F.col("price_vs_competitor") > 0)
    return dearer.select("product_id", "product_name", "category", "retail_price", "avg_competitor_price", "price_vs_competitor")


def monthly_trend_year(w: Warehouse, year: int) -> DataFrame:
    """Months of one year with revenue, profit, orders and growth.

    Growth of the first month looks back into the year before.
    """
    months = analytics.monthly_rollup(w.daily_revenue_trends)
    return months.where(F.col("year") == year).select("year", "month", "month_name", "monthly_revenue", "monthly_profit", "monthly_orders", "mom_growth_pct")


def last_months(w: Warehouse, as_of: dt.date, months: int = 6) -> DataFrame:
    """Revenue and orders per month since ``months`` before ``as_of``.

    The date range reaches the clustered fact as a scan filter.
    """
    day = F.col("order_date")
    recent = revenue_only(w.fct_sales).where((day > F.add_months(F.lit(as_of), -months)) & (day <= F.lit(as_of)))
    return recent.groupBy(F.date_format(day, "yyyy-MM").alias("year_month")).agg(
        F.sum("net_revenue").alias("total_revenue"), F.countDistinct("order_id").alias("num_orders")
    )

"""Pre-aggregates: daily revenue, categories, customer lifetime value."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from martwright.functions import labels, money
from martwright.operators.joins import skew_join
from martwright.operators.ranking import By, global_ntile, rank_by, running_total, share_of_total
from martwright.operators.rows import revenue_only
from martwright.sources.tables import write_stable

MONTH = ["year", "month", "month_name", "quarter"]


def daily_sales(fact: DataFrame, only_revenue: bool = True) -> DataFrame:
    """Sales per day. Orders are counted distinct, spread by (day, order)."""
    day = F.col("order_date")
    totals = revenue_only(fact, only_revenue).groupBy("order_date").agg(
        F.countDistinct("order_id").alias("num_orders"),
        F.count("order_item_id").alias("num_items"),
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("gross_profit").alias("gross_profit"),
        F.sum("cogs").alias("total_cogs"),
        money.mean(F.col("net_revenue"), 2).alias("avg_order_item_value"),
    )
    return totals.select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.dayofweek(day).alias("dow"),
        *[c for c in totals.columns if c != "order_date"],
        money.safe_ratio(F.col("gross_profit"), F.col("net_revenue"), 2, 100).alias("margin_pct"),
    )


def ytd_revenue(daily: DataFrame) -> DataFrame:
    return running_total(daily, ["year"], "order_date", "net_revenue", "ytd_revenue")


def monthly_rollup(daily: DataFrame, calendar: bool = False) -> DataFrame:
    """Sales per month with growth over the previous month that had sales.

    ``calendar`` has a row for every month from the first to the last, those without
    sales with zeros, and compares with the previous calendar month; after a month
    without sales there is no growth figure.
    """
    months = daily.groupBy(*MONTH).agg(
        F.sum("net_revenue").alias("monthly_revenue"),
        F.sum("gross_profit").alias("monthly_profit"),
        F.sum("num_orders").alias("monthly_orders"),
        money.mean(F.col("margin_pct"), 2).alias("avg_margin_pct"),
    )
    return period_growth(every_month(months) if calendar else months, ["year", "month"], "monthly_revenue")


def every_month(months: DataFrame) -> DataFrame:
    """The months of an aggregate and those in between, with zeros where nothing was sold."""
    day = F.make_date("year", "month", F.lit(1))
    span = months.agg(F.min(day).alias("start"), F.max(day).alias("end"))
    each = span.select(F.explode(F.sequence("start", "end", F.expr("interval 1 month"))).alias("_day"))
    kinds = dict(months.dtypes)
    keys = {"year": F.year("_day"), "month": F.month("_day"), "month_name": F.date_format("_day", "MMM"), "quarter": F.quarter("_day")}
    calendar = each.select(*[value.cast(kinds[name]).alias(name) for name, value in keys.items() if name in kinds])
    joined = calendar.join(months.drop("month_name", "quarter"), ["year", "month"], "left")
    return joined.na.fill(0, ["monthly_revenue", "monthly_profit", "monthly_orders"]).select(*months.columns)


def period_growth(months: DataFrame, order: list[str], column: str) -> DataFrame:
    """Previous period's value and growth in percent over a monthly aggregate."""
    window = Window.orderBy(*order)
    previous = F.lag(column).over(window)
    grown = months.withColumn("prev_month_revenue", previous)
    return grown.withColumn(
        "mom_growth_pct", money.safe_ratio(F.col(column) - F.col("prev_month_revenue"), F.col("prev_month_revenue"), 2, 100)
    )


def attach_monthly(daily: DataFrame) -> DataFrame:
    """Month totals and growth on every day of the month.

    Windows over the daily aggregate (one row per day) instead of a second
    aggregation and a join; the previous month is the last earlier one present.
    """
    month = Window.partitionBy("year", "month")
    earlier = Window.orderBy("_month").rangeBetween(Window.unboundedPreceding, -1)
    totals = daily.select(
        "*",
        (F.col("year") * 12 + F.col("month")).alias("_month"),
        F.sum("net_revenue").over(month).alias("monthly_revenue"),
        F.sum("gross_profit").over(month).alias("monthly_profit"),
        F.sum("num_orders").over(month).alias("monthly_orders"),
        money.settle(F.sum("margin_pct").over(month).cast("double") / F.nullif(F.count("margin_pct").over(month), F.lit(0)), 2).alias("avg_margin_pct"),
    )
    before = totals.withColumn("prev_month_revenue", F.last("monthly_revenue").over(earlier)).drop("_month")
    growth = money.safe_ratio(F.col("monthly_revenue") - F.col("prev_month_revenue"), F.col("prev_month_revenue"), 2, 100)
    return before.withColumn("mom_growth_pct", growth)


def daily_revenue_trends(fact: DataFrame) -> DataFrame:
    """Daily series with running year total, month totals and growth."""
    return attach_monthly(ytd_revenue(daily_sales(fact))).select(
        "order_date", "year", "month", "month_name", "quarter", "num_orders", "num_items",
        "net_revenue", "gross_revenue", "gross_profit", "margin_pct", "ytd_revenue",
        "monthly_revenue", "monthly_profit", "monthly_orders", "avg_margin_pct", "prev_month_revenue", "mom_growth_pct",
    )


def category_totals(fact: DataFrame, products: DataFrame, keys: list[str], hot_products: list) -> DataFrame:
    """Totals per product attribute.

    Sums are taken per product before the product table is joined, so that join
    moves one row per sold product. The distinct order count joins lines two columns
    wide: an order hardly has a product twice, so a shuffle to tell would save nothing. Both parts meet in one small final
    aggregation, which treats missing categories like any other value.
    """
    described = products.select("product_sk", *keys)
    per_product = fact.groupBy("product_sk").agg(
        F.count("order_item_id").alias("num_items_sold"),
        F.sum("quantity").alias("total_units_sold"),
        F.sum("net_revenue").alias("total_revenue"),
        F.sum("gross_profit").alias("total_profit"),
        F.sum("margin_pct").alias("margin_sum"),
        F.sum("unit_price").alias("price_sum"),
    )
    sums = per_product.join(described, "product_sk").withColumn("num_products", F.lit(1).cast("bigint")).drop("product_sk")
    sold = fact.select("product_sk", "order_id")
    orders = skew_join(sold, described, "product_sk", hot_products, ["order_id"]).groupBy(*keys).agg(F.countDistinct("order_id").alias("num_orders"))
    measures = [c for c in sums.columns if c not in keys] + ["num_orders"]
    both = sums.unionByName(orders, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def top_product_categories(fact: DataFrame, products: DataFrame, hot_products: list | None = None) -> DataFrame:
    """Category and subcategory performance with ranks and revenue share."""
    keys = ["category", "subcategory"]
    totals = category_totals(revenue_only(fact), products, keys, hot_products or [])
    items = F.col("num_items_sold")
    measured = totals.select(
        *keys,
        "num_products",
        "num_orders",
        "num_items_sold",
        "total_units_sold",
        "total_revenue",
        "total_profit",
        money.safe_ratio(F.col("margin_sum"), items, 2).alias("avg_margin_pct"),
        money.safe_ratio(F.col("price_sum"), items, 2).alias("avg_selling_price"),
        money.safe_ratio(F.col("total_revenue"), F.col("num_orders"), 2).alias("revenue_per_order"),
    )
    ranked = rank_by(rank_by(measured, "total_revenue", "revenue_rank"), "total_profit", "profit_rank")
    return share_of_total(ranked, "total_revenue", "revenue_share_pct")


def customer_totals(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """Revenue orders per customer."""
    first, last = F.min("order_date"), F.max("order_date")
    return revenue_only(fact).groupBy("customer_sk").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.count("order_item_id").alias("total_items"),
        F.sum("net_revenue").alias("total_revenue"),
        F.sum("gross_profit").alias("total_profit"),
        first.alias("first_order_date"),
        last.alias("last_order_date"),
        F.datediff(last, first).alias("active_days"),
        F.datediff(F.lit(as_of), last).alias("days_since_last_order"),
        money.mean(F.col("net_revenue"), 2).alias("avg_item_value"),
    )


def rfm_scores(totals: DataFrame, orientation: str = "reference", **limits: int) -> DataFrame:
    """Recency, frequency and monetary quintiles.

    ``reference`` gives the best customers quintile 1 on every axis;
    ``high_is_best`` gives them quintile 5, which is what the tier names mean.
    """
    if orientation not in ("reference", "high_is_best"):
        raise ValueError(f"unknown orientation {orientation!r}")
    flip = orientation == "high_is_best"
    rows = totals.count()
    axes = [("days_since_last_order", False, "recency_score"), ("total_orders", True, "frequency_score"), ("total_revenue", True, "monetary_score")]
    scored = totals
    for column, descending, name in axes:
        scored = global_ntile(scored, 5, [By(column, descending != flip), By("customer_sk")], name, rows, **limits)
    return scored


def customer_lifetime_value(
    fact: DataFrame, customers: DataFrame, as_of: dt.date, orientation: str = "reference", folder: str | None = None
) -> DataFrame:
    """Lifetime totals, RFM scores and tier per customer with revenue.

    The totals are written once: finding the quintile boundaries reads their key
    columns again, which must not repeat the aggregation of the fact.
    """
    totals = write_stable(customer_totals(fact, as_of), "customer_totals", folder)
    scores = [F.col(c) for c in ("recency_score", "frequency_score", "monetary_score")]
    scored = rfm_scores(totals, orientation)
    scored = scored.withColumn("rfm_total", reduce(lambda a, b: a + b, scores)).withColumn("clv_tier", labels.clv_tier(*scores))
    described = customers.select("customer_sk", "customer_id", "full_name", "email", "city", "country", "region", "age_group", "customer_segment")
    joined = scored.join(described, "customer_sk")
    return joined.select(*described.columns, *[c for c in scored.columns if c != "customer_sk"])

"""Dashboard reports over the star schema.

Reports that only add up measures aggregate the fact by its key first and join the
dimension to that aggregate. Unless stated otherwise all lines count, not only
those of revenue orders; ``only_revenue`` restricts a report to the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from martwright.functions import labels, money
from martwright.operators import pivot
from martwright.operators.joins import skew_join
from martwright.operators.ranking import By
from martwright.operators.rows import distinct_rows, one_row, optional_limit, revenue_only, top_k
from martwright.plans.warehouse import Warehouse


def _whole(amount: Column) -> Column:
    return F.round(amount, 0)


def _margin(scale: int) -> Column:
    return money.safe_ratio(F.sum("margin_sum"), F.sum("lines"), scale)


def sums_by(fact: DataFrame, key: str) -> DataFrame:
    """Additive measures per dimension key: one row per key leaves each task."""
    return fact.groupBy(key).agg(
        F.count("*").alias("lines"),
        F.sum("net_revenue").alias("revenue"),
        F.sum("gross_profit").alias("profit"),
        F.sum("quantity").cast("bigint").alias("units"),
        F.sum("margin_pct").alias("margin_sum"),
        F.sum("unit_price").alias("price_sum"),
    )


def dashboard_kpis(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    """Revenue, orders, active customers, mean line margin, average order value.

    Each distinct count is an aggregate of its own, so that no row is copied per
    counted column.
    """
    fact = revenue_only(w.fct_sales, only_revenue)
    totals = fact.agg(
        F.sum("net_revenue").alias("_revenue"),
        F.countDistinct("order_id").alias("total_orders"),
        money.mean(F.col("margin_pct"), 2).alias("avg_margin_pct"),
    )
    customers = fact.agg(F.countDistinct("customer_sk").alias("active_customers"))
    return one_row(totals, customers).select(
        _whole(F.col("_revenue")).alias("total_revenue"),
        "total_orders",
        "active_customers",
        "avg_margin_pct",
        money.safe_ratio(F.col("_revenue"), F.col("total_orders")).alias("aov"),
    )


def format_kpis(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        labels.format_money(F.col("total_revenue")).alias("total_revenue"),
        F.format_number("total_orders", 0).alias("total_orders"),
        F.format_number("active_customers", 0).alias("active_customers"),
        labels.format_pct(F.col("avg_margin_pct")).alias("avg_margin"),
        labels.format_money(F.col("aov"), 2).alias("aov"),
    )


def dashboard_monthly(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    """Twelve monthly totals in calendar-month order.

    Months of different years stay apart but are ordered by month number, so with
    several years of data the twelve rows are the first months of each year.
    """
    month = F.trunc("order_date", "month")
    totals = revenue_only(w.fct_sales, only_revenue).groupBy(month.alias("month_start")).agg(
        _whole(F.sum("net_revenue")).alias("monthly_revenue")
    )
    named = totals.select(
        F.date_format("month_start", "MMM").alias("month_name"), F.month("month_start").alias("month_num"), "month_start", "monthly_revenue"
    )
    return top_k(named, 12, ["month_num"], ["month_start"])


def _by_product(w: Warehouse, keys: list[str], only_revenue: bool) -> DataFrame:
    sums = sums_by(revenue_only(w.fct_sales, only_revenue), "product_sk")
    return sums.join(w.dim_product.select("product_sk", *keys, "avg_competitor_price"), "product_sk").groupBy(*keys)


def top_categories(w: Warehouse, k: int = 5, only_revenue: bool = False) -> DataFrame:
    totals = _by_product(w, ["category"], only_revenue).agg(_whole(F.sum("revenue")).alias("total_revenue"))
    return top_k(totals, k, [By("total_revenue", True)], ["category"])


def top_products_short(w: Warehouse, k: int = 5, only_revenue: bool = False) -> DataFrame:
    totals = _by_product(w, ["product_name", "category"], only_revenue).agg(_whole(F.sum("revenue")).alias("revenue"))
    top = top_k(totals, k, [By("revenue", True)], ["product_name", "category"])
    return top.withColumnRenamed("product_name", "name")


def daily_series(w: Warehouse) -> DataFrame:
    return w.daily_revenue_trends.select(
        "order_date",
        _whole(F.col("net_revenue")).alias("net_revenue"),
        _whole(F.col("gross_profit")).alias("gross_profit"),
        "num_orders",
        "margin_pct",
    )


def monthly_revenue(w: Warehouse) -> DataFrame:
    """Distinct month rows of the daily series.

    Months of different years with equal figures would merge, as rows without a
    year do.
    """
    rounded = w.daily_revenue_trends.withColumn("monthly_revenue", _whole(F.col("monthly_revenue")))
    return distinct_rows(rounded, ["month_name", "month", "monthly_revenue", "monthly_orders", "avg_margin_pct", "mom_growth_pct"])


def monthly_table(w: Warehouse) -> DataFrame:
    """The month rows as shown: growth as signed text."""
    return monthly_revenue(w).withColumn("growth", labels.format_growth(F.col("mom_growth_pct")))


def category_summary(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    return _by_product(w, ["category"], only_revenue).agg(
        _whole(F.sum("revenue")).alias("revenue"), F.sum("units").alias("units"), _margin(1).alias("avg_margin")
    )


def top_products(w: Warehouse, k: int = 20, only_revenue: bool = False) -> DataFrame:
    """Best sellers with mean price and the competitor price.

    The competitor mean weighs every line alike; lines of unmatched products do not
    count.
    """
    price = F.col("avg_competitor_price")
    matched = F.sum(F.when(price.isNotNull(), F.col("lines")))
    totals = _by_product(w, ["product_name", "category"], only_revenue).agg(
        _whole(F.sum("revenue")).alias("revenue"),
        F.sum("units").alias("units_sold"),
        _margin(1).alias("avg_margin"),
        money.safe_ratio(F.sum("price_sum"), F.sum("lines")).alias("avg_price"),
        money.safe_ratio(F.sum(price * F.col("lines")), matched).alias("competitor_price"),
    )
    return top_k(totals, k, [By("revenue", True)], ["product_name", "category"])


def competitor_scatter(w: Warehouse) -> DataFrame:
    """Our price against the competitor's for the best sellers that have one."""
    priced = top_products(w).where(F.coalesce(F.col("competitor_price"), F.lit(0)) != 0)
    return priced.select(F.col("avg_price").alias("our_price"), "competitor_price", "category")


def price_position(w: Warehouse) -> DataFrame:
    """Best sellers with their distance to the competitor and margin band."""
    delta = F.when(F.col("competitor_price") != 0, F.col("avg_price") - F.col("competitor_price"))
    return top_products(w).select(
        "product_name",
        "category",
        delta.cast("decimal(18,2)").alias("delta"),
        labels.price_direction(delta).alias("direction"),
        labels.margin_band(F.col("avg_margin")).alias("margin_band"),
    )


def product_kpis(w: Warehouse) -> DataFrame:
    """Product count, mean category margin, best category, cheaper best sellers."""
    products = w.dim_product.agg(F.count("*").alias("total_products"))
    categories = category_summary(w).agg(
        money.mean(F.col("avg_margin"), 1).alias("avg_margin"),
        F.min_by("category", F.struct(-F.col("revenue"), "category")).alias("top_category"),
    )
    cheaper = (F.col("avg_price") != 0) & (F.col("competitor_price") != 0) & (F.col("avg_price") < F.col("competitor_price"))
    best = top_products(w).agg(F.count_if(cheaper).alias("price_advantage_count"))
    return one_row(products, categories, best)


def customer_revenue(w: Warehouse, by_key: bool = False, only_revenue: bool = False) -> DataFrame:
    """Orders and revenue per customer name, city and age group.

    Customers of equal name, city and age group merge unless ``by_key`` is set.
    """
    shown = ["full_name", "city", "age_group"]
    keys = [*shown, "customer_sk"] if by_key else shown
    # An order has one customer, so the orders of merged customers add up; one row per customer is joined.
    per_order = revenue_only(w.fct_sales, only_revenue).groupBy("customer_sk", "order_id").agg(F.sum("net_revenue").alias("revenue"))
    per_customer = per_order.groupBy("customer_sk").agg(F.count("order_id").alias("orders"), F.sum("revenue").alias("revenue"))
    described = per_customer.join(w.dim_customer.select("customer_sk", *shown), "customer_sk")
    return described.groupBy(*keys).agg(F.sum("orders").alias("total_orders"), F.sum("revenue").alias("revenue"))


def top_customers(w: Warehouse, k: int = 25, by_key: bool = False, only_revenue: bool = False) -> DataFrame:
    revenue = F.col("revenue")
    totals = customer_revenue(w, by_key, only_revenue)
    kept = [c for c in totals.columns if c != "revenue"]
    described = totals.select(
        *kept,
        _whole(revenue).alias("total_revenue"),
        money.safe_ratio(revenue, F.col("total_orders")).alias("avg_order_value"),
        labels.spend_segment(revenue).alias("segment"),
    )
    return top_k(described, k, [By("total_revenue", True)], [c for c in kept if c != "total_orders"])


def customer_value(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    """Revenue and line count per customer."""
    return revenue_only(w.fct_sales, only_revenue).groupBy("customer_sk").agg(
        F.sum("net_revenue").alias("clv"), F.count("*").alias("lines")
    )


def clv_segments(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    banded = customer_value(w, only_revenue).select(labels.clv_band(F.col("clv")).alias("segment"))
    return banded.groupBy("segment").agg(F.count("*").alias("count"))


def age_group_revenue(w: Warehouse, weighting: str = "line", only_revenue: bool = False) -> DataFrame:
    """Revenue and mean customer value per age group.

    The mean weighs a customer by their lines; ``weighting="customer"`` counts every
    customer once. The weight is carried through one aggregation per customer, so
    the fact is not joined to an aggregate of itself.
    """
    if weighting not in ("line", "customer"):
        raise ValueError(f"unknown weighting {weighting!r}")
    weight = F.col("lines") if weighting == "line" else F.lit(1)
    value = customer_value(w, only_revenue).join(w.dim_customer.select("customer_sk", "age_group"), "customer_sk")
    return value.groupBy("age_group").agg(
        _whole(F.sum("clv")).alias("total_revenue"),
        money.safe_ratio(F.sum(F.col("clv").cast("decimal(24,2)") * weight), F.sum(weight), 0).alias("avg_clv"),
    )


def payment_method_lines(w: Warehouse, only_revenue: bool = False) -> DataFrame:
    fact = revenue_only(w.fct_sales, only_revenue)
    return fact.groupBy(F.col("payment_method").alias("method")).agg(F.count("*").alias("count"))


def registration_trend(w: Warehouse) -> DataFrame:
    """Registrations by calendar month, all years together."""
    day = F.col("registration_date")
    return w.dim_customer.groupBy(F.date_format(day, "MMM").alias("month"), F.month(day).alias("month_num")).agg(
        F.count("*").alias("count")
    )


def customer_kpis(w: Warehouse, over: str = "top_n") -> DataFrame:
    """Customer count, mean value, VIPs and mean orders.

    Means and VIPs cover the 25 best customers, or all with ``over="all"``.
    """
    if over == "top_n":
        chosen = top_customers(w)
    elif over == "all":
        totals = customer_revenue(w)
        chosen = totals.select("total_orders", F.col("revenue").alias("total_revenue"), labels.spend_segment(F.col("revenue")).alias("segment"))
    else:
        raise ValueError(f"unknown scope {over!r}")
    customers = w.dim_customer.agg(F.count("*").alias("total_customers"))
    means = chosen.agg(
        money.mean(F.col("total_revenue"), 0).alias("avg_clv"),
        F.count_if(F.col("segment") == "VIP").alias("vip_count"),
        money.mean(F.col("total_orders"), 1).alias("avg_orders_per_customer"),
    )
    return one_row(customers, means)


PRODUCT_COLUMNS = ["category", "subcategory", "supplier_name"]
CUSTOMER_COLUMNS = ["age_group", "city", "country"]


def _fact_columns() -> dict[str, Column]:
    day = F.col("order_date")
    return {
        "payment_method": F.col("payment_method"),
        "order_status": F.col("order_status"),
        "order_month": F.date_format(day, "MMM"),
        "order_quarter": F.concat(F.lit("Q"), F.ceil(F.month(day) / 3).cast("string")),
        "order_year": F.year(day).cast("string"),
        "quantity": F.col("quantity"),
        "unit_price": F.round("unit_price", 2),
        "net_revenue": F.round("net_revenue", 2),
        "gross_profit": F.round("gross_profit", 2),
        "margin_pct": F.round("margin_pct", 1),
        "competitor_price_delta": F.round("price_delta", 2),
    }


PIVOT_COLUMNS = [
    *PRODUCT_COLUMNS, *CUSTOMER_COLUMNS, "payment_method", "order_status", "order_month", "order_quarter", "order_year",
    "quantity", "unit_price", "net_revenue", "gross_profit", "margin_pct", "competitor_price_delta",
]


def pivot_rows(w: Warehouse, limit: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Flat rows for cross tables, 17 columns or the wanted ones; ``limit`` 0 keeps all.

    The fact holds matched lines only, one product and customer each, so a dimension
    without a wanted column need not be joined. The date columns come from the fact's
    own date, which the calendar covers completely.
    """
    wanted = columns or PIVOT_COLUMNS
    unknown = [c for c in wanted if c not in PIVOT_COLUMNS]
    if unknown:
        raise ValueError(f"unknown pivot columns {unknown}")
    lines = w.fct_sales
    for dimension, key, hot, offered in (
        ("dim_product", "product_sk", "hot_products", PRODUCT_COLUMNS),
        ("dim_customer", "customer_sk", "hot_customers", CUSTOMER_COLUMNS),
    ):
        taken = [c for c in offered if c in wanted]
        if taken:
            lines = skew_join(lines, getattr(w, dimension).select(key, *taken), key, getattr(w, hot), ["sale_sk"])
    own = _fact_columns()
    return optional_limit(lines.select(*[own[c].alias(c) if c in own else c for c in wanted]), limit)


def cross_table(
    w: Warehouse,
    rows: list[str],
    cols: list[str],
    agg: str = "count",
    value: str | tuple[str, str] | None = None,
    totals: bool = True,
    order: str | None = None,
) -> DataFrame:
    """Cells of a cross table over the flat rows, reading only what it needs."""
    values = [value] if isinstance(value, str) else list(value or [])
    needed = dict.fromkeys([*rows, *cols, *values, *([order] if order else [])])
    return pivot.pivot_long(pivot_rows(w, columns=list(needed)), rows, cols, agg, value, totals, order)


def preset(w: Warehouse, name: str, totals: bool = False) -> DataFrame:
    """One of the preset cross tables."""
    return cross_table(w, **pivot.PRESETS[name], totals=totals)

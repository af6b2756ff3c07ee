"""The reports each dashboard page shows, by name.

Every entry is a lazy frame; ``records`` turns a page into plain data for an API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from martwright.operators.ranking import By
from martwright.operators.rows import order_for_display, to_records
from martwright.plans import dashboards
from martwright.plans.warehouse import Warehouse


def home(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "kpi": dashboards.format_kpis(dashboards.dashboard_kpis(w)),
        "monthly_chart": order_for_display(dashboards.dashboard_monthly(w), ["month_num", "month_start"]),
        "category_chart": dashboards.top_categories(w),
        "top_products": dashboards.top_products_short(w),
    }


def revenue(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "daily": order_for_display(dashboards.daily_series(w), ["order_date"]),
        "monthly": order_for_display(dashboards.monthly_table(w), ["month"]),
    }


def products(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "kpis": dashboards.product_kpis(w),
        "categories": order_for_display(dashboards.category_summary(w), [By("revenue", True)]),
        "top_products": dashboards.top_products(w),
        "price_position": dashboards.price_position(w),
        "competitor": dashboards.competitor_scatter(w),
    }


def customers(w: Warehouse) -> dict[str, DataFrame]:
    return {
        "kpis": dashboards.customer_kpis(w),
        "top_customers": dashboards.top_customers(w),
        "clv_segments": dashboards.clv_segments(w),
        "age_groups": dashboards.age_group_revenue(w),
        "payment_methods": order_for_display(dashboards.payment_method_lines(w), [By("count", True)]),
        "registration_trend": order_for_display(dashboards.registration_trend(w), ["month_num"]),
    }


def records(page: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """All records of every report of a page."""
    return {name: to_records(frame) for name, frame in page.items()}

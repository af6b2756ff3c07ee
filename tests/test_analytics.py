import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import Window, functions as F

from martwright.plans import analytics, dashboards

FACT = """order_item_id string, order_id string, order_date date, customer_sk long, product_sk long, is_revenue_order boolean,
    quantity int, unit_price decimal(10,2), gross_revenue decimal(18,2), net_revenue decimal(18,2), cogs decimal(18,2),
    gross_profit decimal(18,2), margin_pct decimal(20,2)"""


def line(i, order, day, net, profit="1", customer=1, product=1, revenue=True):
    return (f"i{i}", order, dt.date.fromisoformat(day), customer, product, revenue, 1, D(net), D(net), D(net), D("0"), D(profit), D("10"))


@pytest.fixture(scope="module")
def gaps(spark):
    """Sales in December, January (none in February), March; nothing earned in April."""
    lines = [
        line(1, "a", "2023-12-05", "50"),
        line(2, "b", "2024-01-05", "100"),
        line(3, "b", "2024-01-06", "100"),
        line(4, "c", "2024-03-01", "300"),
        line(5, "d", "2024-04-01", "0", "0"),
        line(6, "e", "2024-05-01", "10"),
        line(7, "f", "2024-05-01", "99", revenue=False),
    ]
    return spark.createDataFrame(lines, FACT)


def test_monthly_growth_over_present_months(gaps):
    months = {(r.year, r.month): r for r in analytics.monthly_rollup(analytics.daily_sales(gaps)).collect()}
    assert [months[k].mom_growth_pct for k in sorted(months)] == [None, D("300.00"), D("50.00"), D("-100.00"), None]
    assert months[2024, 3].prev_month_revenue == D("200.00")
    assert months[2024, 4].avg_margin_pct is None


def test_monthly_growth_over_calendar(gaps):
    months = {(r.year, r.month): r for r in analytics.monthly_rollup(analytics.daily_sales(gaps), calendar=True).collect()}
    assert [months[k].mom_growth_pct for k in sorted(months)] == [None, D("300.00"), D("-100.00"), None, D("-100.00"), None]
    assert sorted(months)[2] == (2024, 2) and (months[2024, 2].monthly_revenue, months[2024, 2].monthly_orders) == (D("0.00"), 0)
    assert (months[2024, 2].month_name, months[2024, 2].quarter) == ("Feb", 1)


def test_daily_trends(gaps):
    days = {r.order_date: r for r in analytics.daily_revenue_trends(gaps).collect()}
    assert len(days) == 6
    second = days[dt.date(2024, 1, 6)]
    assert (second.ytd_revenue, second.monthly_revenue, second.mom_growth_pct) == (D("200.00"), D("200.00"), D("300.00"))
    assert days[dt.date(2023, 12, 5)].ytd_revenue == D("50.00")
    assert days[dt.date(2024, 4, 1)].margin_pct is None
    assert days[dt.date(2024, 5, 1)].net_revenue == D("10.00")


def test_daily_trends_agree_with_the_rollup(small):
    columns = ["year", "month", "monthly_revenue", "monthly_orders", "avg_margin_pct", "prev_month_revenue", "mom_growth_pct"]
    joined = small.daily_revenue_trends.select(columns).distinct()
    rollup = analytics.monthly_rollup(analytics.daily_sales(small.fct_sales)).select(columns)
    assert joined.exceptAll(rollup).count() == 0 and joined.count() == rollup.count()


@pytest.mark.parametrize("customers", [3, 5, 7, 12])
@pytest.mark.parametrize("orientation", ["reference", "high_is_best"])
def test_rfm_ties(spark, customers, orientation):
    totals = spark.range(1, customers + 1).select(
        F.col("id").alias("customer_sk"), (F.col("id") % 3).cast("int").alias("days_since_last_order"),
        F.lit(2).cast("long").alias("total_orders"), (F.col("id") * 10).cast("decimal(18,2)").alias("total_revenue"),
    )
    got = {r.customer_sk: (r.recency_score, r.frequency_score, r.monetary_score) for r in analytics.rfm_scores(totals, orientation, direct_rows=2, sample_rows=40).collect()}
    best_first = orientation == "reference"
    days = F.asc("days_since_last_order") if best_first else F.desc("days_since_last_order")
    money = F.desc("total_revenue") if best_first else F.asc("total_revenue")
    tile = lambda order: F.ntile(5).over(Window.orderBy(order, "customer_sk"))
    wanted = totals.select("customer_sk", tile(days).alias("r"), tile(F.col("total_orders")).alias("f"), tile(money).alias("m"))
    assert got == {r.customer_sk: (r.r, r.f, r.m) for r in wanted.collect()}


def test_rfm_names_its_orientations(spark):
    with pytest.raises(ValueError):
        analytics.rfm_scores(spark.range(1).withColumnRenamed("id", "customer_sk"), "sideways")


def test_categories_keep_missing_names_and_count_orders_once(spark):
    lines = [line(1, "a", "2024-01-01", "10", product=1), line(2, "a", "2024-01-01", "10", product=2), line(3, "b", "2024-01-01", "5", product=3)]
    products = spark.createDataFrame([(1, "X", None), (2, "X", None), (3, None, None)], "product_sk long, category string, subcategory string")
    for hot in ([], [1]):
        got = {r.category: r for r in analytics.top_product_categories(spark.createDataFrame(lines, FACT), products, hot).collect()}
        assert (got["X"].num_products, got["X"].num_orders, got["X"].num_items_sold, got["X"].revenue_share_pct) == (2, 1, 2, D("80.00"))
        assert (got[None].num_orders, got[None].revenue_rank, got["X"].revenue_rank) == (1, 2, 1)


def test_customer_value_plan_has_no_global_window(small, plan):
    text = plan(analytics.customer_lifetime_value(small.fct_sales, small.dim_customer, small.as_of))
    assert "Window" not in text and "SinglePartition" not in text


def test_reports_aggregate_before_joining(small, plan):
    text = plan(dashboards.category_summary(small))
    assert text.index("HashAggregate") < text.index("Join") < text.rindex("HashAggregate")
    assert "CartesianProduct" not in plan(dashboards.product_kpis(small))


def test_revenue_only_switch(small):
    everything = dashboards.dashboard_kpis(small).first()
    revenue = dashboards.dashboard_kpis(small, only_revenue=True).first()
    assert revenue.total_revenue < everything.total_revenue and revenue.total_orders < everything.total_orders


def test_unknown_switches(small):
    with pytest.raises(ValueError):
        dashboards.age_group_revenue(small, weighting="none")
    with pytest.raises(ValueError):
        dashboards.customer_kpis(small, over="none")

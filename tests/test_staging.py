import datetime as dt
from decimal import Decimal as D

from martwright.plans import staging
from martwright.sources import schemas

AS_OF = dt.date(2024, 12, 31)


def loose(schema):
    """The schema with every column nullable, for broken rows."""
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def test_items(spark):
    rows = [
        ("a", "o", "p", 2, D("10.00"), None),
        ("b", "o", "p", 2, D("10.00"), D("-0.1000")),
        ("c", "o", "p", 2, D("10.00"), D("1.5000")),
        ("d", "o", "p", 3, D("3.33"), D("0.3000")),
        ("e", "o", "p", 0, D("10.00"), D("0")),
        ("f", "o", "p", -1, D("10.00"), D("0")),
        ("g", "o", "p", 1, D("0.00"), D("0")),
        (None, "o", "p", 1, D("1.00"), D("0")),
        ("i", None, "p", 1, D("1.00"), D("0")),
        ("j", "o", None, 1, D("1.00"), D("0")),
    ]
    raw = spark.createDataFrame(rows, loose(schemas.ORDER_ITEMS))
    got = {r.order_item_id: r for r in staging.stg_order_items(raw).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert [got[k].discount for k in "abcd"] == [D("0"), D("0"), D("1"), D("0.3")]
    # Revenue takes the discount as delivered.
    assert [got[k].net_revenue for k in "abcd"] == [D("20.00"), D("22.00"), D("-10.00"), D("6.99")]
    assert got["d"].gross_revenue == D("9.99")
    clamped = {r.order_item_id: r.net_revenue for r in staging.stg_order_items(raw, clamp_revenue=True).collect()}
    assert clamped == {"a": D("20.00"), "b": D("20.00"), "c": D("0.00"), "d": D("6.99")}


def test_orders(spark):
    day = dt.date(2024, 2, 29)
    rows = [
        ("1", "c", day, " card ", " Completed "),
        ("2", "c", day, None, "Completed"),
        ("3", "c", day, "card", None),
        ("4", "c", None, "card", "Completed"),
        ("5", "c", day, "card", "Shipped"),
        ("6", None, day, "card", "Shipped"),
    ]
    raw = spark.createDataFrame(rows, loose(schemas.ORDERS))
    got = {r.order_id: r for r in staging.stg_orders(raw).collect()}
    assert set(got) == {"1", "2", "3", "5"}
    assert [got[k].is_revenue_order for k in "1235"] == [False, True, False, True]
    assert got["1"].order_status == "Completed" and got["1"].payment_method == "card"
    assert (got["1"].order_year, got["1"].order_month, got["1"].order_quarter) == (2024, 2, 1)
    trimmed = {r.order_id: r.is_revenue_order for r in staging.stg_orders(raw, trim_first=True).collect()}
    assert trimmed["1"] is True


def test_customers(spark):
    def row(key, days=0, email="A@X", registered=True):
        day = AS_OF - dt.timedelta(days=days) if registered else None
        return (key, " N ", " female ", email, " C ", "UAE", day, "65+")

    rows = [row("a", 90), row("b", 91), row("c", 365), row("d", 366), row("e", email=None), row("f", registered=False)]
    raw = spark.createDataFrame(rows, loose(schemas.CUSTOMERS))
    got = {r.customer_id: r for r in staging.stg_customers(raw, AS_OF).collect()}
    assert set(got) == set("abcd")
    assert [got[k].tenure_days for k in "abcd"] == [90, 91, 365, 366]
    assert (got["a"].gender, got["a"].email, got["a"].full_name, got["a"].city) == ("FEMALE", "a@x", "N", "C")


def test_products(spark):
    prices = ["49.99", "50", "199.99", "200", "499.99", "500"]
    rows = [(p, "c", None, " n ", D(p), D("10"), None) for p in prices]
    rows += [("free", "c", None, "n", D("0"), D("1"), None), ("nocost", "c", None, "n", D("1"), D("0"), None)]
    raw = spark.createDataFrame(rows, loose(schemas.PRODUCTS))
    got = {r.product_id: r for r in staging.stg_products(raw).collect()}
    assert [got[p].price_tier for p in prices] == ["Budget", "Mid-range", "Mid-range", "Premium", "Premium", "Luxury"]
    assert set(got) == set(prices)
    assert got["50"].gross_margin_pct == D("80.00") and got["50"].product_name == "n"


def test_load_time_passes_through(spark):
    raw = schemas.with_load_ts(spark.createDataFrame([("1", "c", dt.date(2024, 1, 1), "x", "y")], schemas.ORDERS))
    assert staging.stg_orders(raw).columns[-1] == "_loaded_at"

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martwright.plans import marts, staging
from martwright.plans.warehouse import Warehouse
from martwright.sources import schemas
from martwright.sources.tables import curve, curve_clustered

AS_OF = dt.date(2024, 12, 31)


@pytest.fixture(scope="module")
def raw(spark):
    """Few keys, one hot product, order and customer, and orphans of every kind."""
    customers = [(f"C{i}", f"Name {i % 3}", "Male", f"M{i}@x", "City", "UAE", dt.date(2024, 1, 1), "65+") for i in range(6)]
    products = [(f"P{i}", "Cat", "Sub" if i < 4 else None, f"Thing {i}", D("10.00") * (i + 1), D("4.00"), "S") for i in range(6)]
    orders = [(f"O{i}", "C0" if i % 3 == 0 else f"C{i % 6}", dt.date(2024, 1 + i % 12, 1), "card", "Completed") for i in range(60)]
    orders.append(("OX", "nobody", dt.date(2024, 1, 1), "card", "Completed"))
    items = [(f"I{i}", "O0" if i % 3 == 0 else f"O{i % 60}", "P0" if i % 2 else f"P{i % 6}", 1 + i % 4, D("12.50"), D("0.1")) for i in range(600)]
    items += [("IX", "missing", "P0", 1, D("1"), None), ("IY", "O1", "missing", 1, D("1"), None), ("IZ", "OX", "P0", 1, D("1"), None)]
    prices = [(" thing 0 ", "x", "x", D("9.00"), None, None, None), ("THING 0", "x", "x", D("10.01"), None, None, None), ("thing 0 v2", "x", "x", D("1"), None, None, None)]
    return schemas.RawTables(
        spark.createDataFrame(customers, schemas.CUSTOMERS),
        spark.createDataFrame(products, schemas.PRODUCTS),
        spark.createDataFrame(orders, schemas.ORDERS),
        spark.createDataFrame(items, schemas.ORDER_ITEMS),
        spark.createDataFrame(prices, schemas.COMPETITOR_PRICES),
    )


@pytest.fixture(scope="module")
def house(spark, raw):
    return Warehouse(spark, raw, AS_OF)


def test_competitor_join(house):
    got = {r.product_id: r for r in house.dim_product.collect()}
    assert len(got) == 6
    # Exact match of the normalised name; both prices count.
    assert got["P0"].avg_competitor_price == D("9.505000") and got["P0"].price_vs_competitor == D("0.50")
    assert got["P1"].avg_competitor_price is None and got["P1"].price_vs_competitor is None
    assert [got[f"P{i}"].product_sk for i in range(6)] == [1, 2, 3, 4, 5, 6]


def test_fact_against_brute_force(raw, house):
    customers = {r.customer_id for r in raw.customers.collect()}
    orders = {r.order_id: r for r in raw.orders.collect() if r.customer_id in customers}
    products = {r.product_id: r for r in raw.products.collect()}
    wanted = {}
    for item in raw.order_items.collect():
        if item.order_id in orders and item.product_id in products:
            net = (item.quantity * item.unit_price * (1 - (item.discount or 0))).quantize(D("0.01"))
            wanted[item.order_item_id] = (orders[item.order_id].order_date, net, net - item.quantity * products[item.product_id].base_cost)
    got = {r.order_item_id: (r.order_date, r.net_revenue, r.gross_profit) for r in house.fct_sales.collect()}
    assert got == wanted and len(got) == 600


def test_fact_with_hot_keys_salted(spark, raw, house, monkeypatch):
    """Hot keys found in the inputs do not change the fact."""
    from martwright.operators import joins

    seen = []

    def every_row(df, keys, **_):
        found = joins.hot_values(df, keys, sample=1, fewest=10)
        seen.append(found)
        return found

    monkeypatch.setattr(marts, "hot_values", every_row)
    monkeypatch.setattr(marts, "hot_keys", lambda df, key: every_row(df, [key])[key])
    salted = house.sales()
    assert any("O0" in f.get("order_id", []) for f in seen) and any("P0" in f.get("product_id", []) for f in seen)
    stored = house.fct_sales.drop("loaded_at").select(salted.columns)
    assert salted.exceptAll(stored).count() == 0 and stored.exceptAll(salted).count() == 0


def test_build_time_is_one_value(house):
    times = [t.select(c).distinct().collect() for t, c in ((house.dim_customer, "updated_at"), (house.dim_product, "updated_at"), (house.fct_sales, "loaded_at"))]
    assert all(len(t) == 1 for t in times) and len({t[0][0] for t in times}) == 1


def test_clustered_fact_skips_by_date(house, plan):
    scan = house.fct_sales.where(F.col("order_date") > F.lit(dt.date(2024, 6, 1))).agg(F.sum("net_revenue"))
    text = plan(scan)
    assert "GreaterThan(order_date" in text
    assert "ReadSchema: struct<order_date:date,net_revenue:decimal(18,2)>" in text


def test_stored_fact_follows_the_curve_inside_its_files(spark, small):
    for path in small.fct_sales.inputFiles():
        places = [r[0] for r in spark.read.parquet(path).coalesce(1).select(small.fact_curve).collect()]
        assert places == sorted(places)


def test_curve_takes_bits_by_turns(spark):
    most = (1 << 16) - 1
    rows = [(0, 0), (most, 0), (0, most), (most, most), (0b1011, 0b0110), (None, 5), (-3, most + 9)]
    frame = spark.createDataFrame(rows, "a long, b long")
    bounds = (F.lit(0), F.lit(most))
    got = [r[0] for r in frame.select(curve((F.col("a"), *bounds), (F.col("b"), *bounds))).collect()]

    def by_hand(a, b):
        a, b = (min(max(x or 0, 0), most) for x in (a, b))
        return sum((a >> i & 1) << 2 * i + 1 | (b >> i & 1) << 2 * i for i in range(16))

    assert got == [by_hand(*row) for row in rows]


def test_both_columns_skip_row_groups(spark, tmp_path):
    """Of row groups written along the curve a filter on either column reads few."""
    import pyarrow.parquet as pq

    rows = spark.range(200_000).selectExpr("date_add(date '2020-01-01', cast(pmod(xxhash64(id), 1000) as int)) as day", "pmod(xxhash64(id, 1), 5000) as product", "repeat('x', 50) as pad")
    first = F.lit(dt.date(2020, 1, 1))
    place = curve((F.datediff("day", first), F.lit(0), F.lit(999)), (F.col("product"), F.lit(0), F.lit(4999)))
    writer = curve_clustered(rows, place).write.option("parquet.block.size", 65536).option("parquet.page.row.count.limit", 1000)
    writer.option("parquet.block.row.count.limit", 2000).parquet(f"{tmp_path}/curve")
    groups = []
    for path in (tmp_path / "curve").glob("part-*"):
        meta = pq.ParquetFile(path).metadata
        for i in range(meta.num_row_groups):
            columns = {meta.row_group(i).column(c).path_in_schema: meta.row_group(i).column(c).statistics for c in range(2)}
            groups.append((meta.row_group(i).num_rows, columns["day"], columns["product"]))
    assert sum(n for n, _, _ in groups) == 200_000 and len(groups) >= 40
    day, product = dt.date(2021, 5, 1), 1234
    by_day = [g for g in groups if g[1].min <= day <= g[1].max]
    by_product = [g for g in groups if g[2].min <= product <= g[2].max]
    assert len(by_day) < 0.35 * len(groups) and len(by_product) < 0.35 * len(groups)


def test_fact_joins_without_cross_product_or_broadcast_of_lines(small, plan):
    text = plan(small.sales())
    assert "SortMergeJoin" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_dates(spark):
    days = [dt.date(2023, 12, 31), dt.date(2024, 2, 29), dt.date(2024, 12, 30), dt.date(2024, 12, 31)]
    table = {r.date_actual: r for r in marts.date_dim(spark, dt.date(2023, 1, 1), AS_OF, AS_OF).collect()}
    assert len(table) == 731
    new_year, leap, monday, last = (table[d] for d in days)
    assert (new_year.is_weekend, new_year.day_name, new_year.day_of_week, new_year.season) == (True, "Sun", 1, "Winter")
    assert (leap.date_sk, leap.day_of_year, leap.quarter_label, leap.year_month) == (20240229, 60, "Q1", "2024-02")
    # ISO week 1 of the following year.
    assert (monday.week_of_year, monday.is_weekday, monday.relative_period) == (1, True, "Yesterday")
    assert (last.relative_period, last.month_year_label, last.fiscal_label, last.is_holiday) == ("Today", "Dec 2024", "Q4 2024", False)
    assert table[dt.date(2024, 12, 29)].relative_period == "This Month"
    assert table[dt.date(2024, 11, 30)].relative_period == "Prior"


def test_relative_week(spark):
    table = {r.date_actual: r.relative_period for r in marts.date_dim(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 20), dt.date(2024, 1, 18)).collect()}
    assert [table[dt.date(2024, 1, d)] for d in (14, 15, 17, 18, 19)] == ["This Month", "This Week", "Yesterday", "Today", "This Week"]


def test_segments_and_regions(spark):
    from martwright.functions.labels import country_region, tenure_segment

    df = spark.createDataFrame([(90, "UAE"), (91, "Japan"), (365, None), (366, "Chile")], "days int, country string")
    got = df.select(tenure_segment(F.col("days")).alias("s"), country_region(F.col("country")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("New", "Middle East"), ("Regular", "APAC"), ("Regular", "Other"), ("Loyal", "Other")]


def test_build_names_eleven_models(house):
    assert len(house.build()) == 11


def test_dimension_of_duplicate_ids(spark):
    """Repeated ids are kept and numbered, as an outer window would."""
    rows = [("C1", "A", None, f"{i}@x", None, None, AS_OF, None) for i in range(3)]
    stg = staging.stg_customers(spark.createDataFrame(rows, schemas.CUSTOMERS), AS_OF)
    assert sorted(r.customer_sk for r in marts.dim_customer(stg).collect()) == [1, 2, 3]


def test_fact_shuffles_only_what_it_is_derived_from(spark, raw, monkeypatch):
    """Keys and measures are derived after the last shuffle, and the digest is not stored beside its id."""
    kept = []
    store = Warehouse._stored
    monkeypatch.setattr(Warehouse, "_stored", lambda house, df, name: kept.append(df) or store(house, df, name))
    house = Warehouse(spark, raw, AS_OF)
    rows = house.fct_sales
    written = next(df for df in kept if "order_item_id" in df.columns)
    nodes, dealt = [written._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        dealt += [node] if node.nodeName() == "RebalancePartitions" else []
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert len(dealt) == 1
    shuffled = {dealt[0].output().apply(i).name() for i in range(dealt[0].output().size())}
    assert "order_item_id" in shuffled and not shuffled & {"sale_sk", "gross_revenue", "net_revenue", "cogs", "gross_profit", "margin_pct", "_curve"}
    assert "sale_sk" not in written.columns and rows.columns[0] == "sale_sk"


def test_revenue_of_a_discount_out_of_range(spark, raw):
    """Revenue that does not follow from the discount shown is taken along as it is."""
    odd = [("J1", "O1", "P1", 2, D("10.00"), D("1.5")), ("J2", "O1", "P1", 2, D("10.00"), D("-0.5")), ("J3", "O1", "P1", 2, D("10.00"), None)]
    items = spark.createDataFrame(odd, schemas.ORDER_ITEMS)
    house = Warehouse(spark, schemas.RawTables(raw.customers, raw.products, raw.orders, items, raw.competitor_prices), AS_OF)
    got = {r.order_item_id: (r.discount, r.gross_revenue, r.net_revenue) for r in house.fct_sales.collect()}
    assert got == {"J1": (D("1"), D("20"), D("-10")), "J2": (D("0"), D("20"), D("30")), "J3": (D("0"), D("20"), D("20"))}


def test_ids_of_lines_go_packed(spark, small):
    """Ids of digits and dashes take half the bytes in every shuffle of the fact, others come through as they are."""
    lines = small.sale_lines()
    assert dict(lines.dtypes)["order_item_id"] == "binary"
    assert lines.agg(F.max(F.length("order_item_id"))).first()[0] <= small.stg_order_items.agg(F.max(F.length("order_item_id"))).first()[0] / 2 + 1
    odd = small.stg_order_items.withColumn("order_item_id", F.when(F.crc32("order_item_id") % 3 == 0, F.concat(F.lit("Pos. "), "order_item_id")).otherwise(F.col("order_item_id")))
    got = marts.fct_sales(odd, small.stg_orders, small.dim_customer, small.dim_product).select("sale_sk", "order_item_id")
    wanted = odd.select(F.md5("order_item_id").alias("sale_sk"), "order_item_id")
    assert got.exceptAll(wanted).isEmpty() and got.count() == wanted.count()


def test_stored_fact_gives_all_columns_back(spark, small):
    """Columns that follow from others are not stored; read again they are what the lazy fact has, types included."""
    day = dt.date(2024, 2, 29)
    customers = spark.createDataFrame([("c", "n", "Male", "e@x", "City", "Canada", day, "18-24")], schemas.CUSTOMERS)
    products = spark.createDataFrame([("p1", "K", "S", "Pen", D("9.99"), D("3.33"), "x"), ("p2", "K", "S", "Ink", D("5.00"), D("7.77"), "x")], schemas.PRODUCTS)
    orders = spark.createDataFrame([("o1", "c", day, "card", "Completed"), ("o2", "c", dt.date(2024, 12, 31), None, None)], schemas.ORDERS)
    lines = [("1-1", "o1", "p1", 3, D("9.99"), D("0.3333")), ("1-2", "o1", "p2", 7, D("0.01"), None), ("x", "o2", "p2", 1, D("99999999.99"), D("1.5")), ("x", "o2", "p1", 2, D("1.00"), D("-0.1"))]
    items = spark.createDataFrame(lines, schemas.ORDER_ITEMS)
    prices = spark.createDataFrame([("pen", "S", "K", D("9.50"), "In Stock", None, "y"), ("PEN ", "S", "K", D("9.51"), "In Stock", None, "y"), ("pen", "S", "K", D("9.53"), "In Stock", None, "y")], schemas.COMPETITOR_PRICES)
    house = Warehouse(spark, schemas.RawTables(customers=customers, products=products, orders=orders, order_items=items, competitor_prices=prices), dt.date(2024, 12, 31))
    for w, rows in ((house, 4), (small, None)):
        stored, lazy = w.fct_sales.drop("loaded_at"), w.sales()
        assert stored.dtypes == lazy.dtypes
        assert stored.exceptAll(lazy).isEmpty() and lazy.exceptAll(stored).isEmpty() and stored.count() == (rows or lazy.count())
        written = spark.read.parquet(w.fct_sales.inputFiles()[0]).columns
        assert not {"order_date_sk", "gross_revenue", "gross_profit", "price_delta"} & set(written)

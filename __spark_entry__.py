
from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.price_pages import render_price_pages
from checks.statements import oracle_statements
from martwright.functions import labels
from martwright.functions.keys import surrogate_key
from martwright.functions.money import doubles, settle
from martwright.functions.text import lenient_date, parse_price
from martwright.operators import joins, pivot, quality, rows
from martwright.operators.ranking import By, global_ntile, global_row_number, with_position
from martwright.plans import analytics, dashboards, guarded, marts, model_tests, questions, staging, validation
from martwright.plans.warehouse import Warehouse
from martwright.sources import files, html_tables, sample_tables, schemas
from martwright.sources.tables import Versions, fingerprint, materialize, write_stable

try:  # the driver may take this part of the library away
    import corpus_pipeline
    from martwright.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("corpus_pipeline", "martwright.llm")):
        raise
    corpus_pipeline = llm_queries = None

AS_OF = dt.date(2001, 12, 31)
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SOURCES = ["customer", "nation", "orders", "lineitem", "part"]

_warehouses: dict[tuple, Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """The star schema of a folder, built once per session and state of its files."""
    state = fingerprint(spark, [f"{folder}/{name}.parquet" for name in SOURCES])
    key = (spark.sparkContext.applicationId, folder, state)
    if key not in _warehouses:
        # A star schema of files that have changed since is of no use any more.
        for old in [k for k in _warehouses if k[:2] == key[:2]]:
            _warehouses.pop(old).close()
        _warehouses[key] = Warehouse(spark, sample_tables.raw_tables(spark, folder), AS_OF)
    return _warehouses[key]


def _lenient_dates(w: Warehouse) -> DataFrame:
    method, day = F.col("payment_method"), F.col("order_date")
    text = F.when(method == "1-URGENT ", F.date_format(day, "yyyy-'13'-dd")).when(method == "5-LOW ", "unknown")
    return w.raw.orders.select("order_id", lenient_date(text.otherwise(F.date_format(day, "yyyy-MM-dd"))).alias("order_date"))


def _parse_price(w: Warehouse) -> DataFrame:
    price, category = F.col("retail_price"), F.col("category")
    text = F.when(category == "ECONOMY", F.concat(F.lit(" € "), price.cast("string"))).when(category == "SMALL", "N/A")
    text = text.when(category == "PROMO", F.concat(F.lit("1."), price.cast("string")))
    texts = w.raw.products.select("product_id", text.otherwise(F.concat(F.lit("$"), F.format_number(price, 2))).alias("price_text"))
    return texts.withColumn("price", parse_price(F.col("price_text")))


def _html_table_extract(spark: SparkSession, folder: str) -> DataFrame:
    products = sample_tables.numbered_products(sample_tables.table(spark, folder, "part"))
    priced = render_price_pages(products)
    pages = sample_tables.table(spark, folder, "pages").select("url", "html")
    found = html_tables.extract_html_tables(pages.unionByName(priced))
    return found.select("product_name", "category", "section", "competitor_price", "stock_status")


def _csv_round_trip(w: Warehouse) -> DataFrame:
    path = f"{w.folder}/csv/orders"
    files.export_csv(w.raw.orders, path)
    return files.read_csv(w.spark, path, schemas.ORDERS)


def _load_report(w: Warehouse) -> DataFrame:
    base = f"{w.folder}/load"
    for name in schemas.RAW_TABLES:
        files.export_csv(getattr(w.raw, name), f"{base}/files/{name}.csv")
    loads = files.csv_loads(f"{base}/files", f"{base}/tables")
    loads["missing"] = files.Load(f"{base}/files/missing.csv", f"{base}/tables/missing", schemas.ORDERS)
    return files.load_all(w.spark, loads).select(F.col("table").alias("table_name"), "status", "rows")


def _row_counts(spark: SparkSession, folder: str, w: Warehouse) -> DataFrame:
    sources = {"customers": "customer", "products": "part", "orders": "orders", "order_items": "lineitem"}
    expected = {name: sample_tables.table(spark, folder, source).count() for name, source in sources.items()}
    return files.check_row_counts({name: getattr(w.raw, name) for name in schemas.RAW_TABLES}, expected)


def _duplicate_ids(w: Warehouse) -> DataFrame:
    keys = {"order_items": "order_item_id", "orders": "order_id", "customers": "customer_id", "products": "product_id"}
    found = [
        validation.repeated_keys(getattr(w.raw, t), k).select(F.lit(t).alias("table_name"), F.col(k).alias("key"), "cnt")
        for t, k in keys.items()
    ]
    return quality.all_checks(*found)


def _insert_missing_dates(w: Warehouse) -> DataFrame:
    wanted = ["date_sk", "date_actual", "season"]
    existing = marts.date_attributes(w.stg_orders.select(F.col("order_date").alias("date_actual")).distinct(), AS_OF)
    return joins.insert_missing(existing.select(*wanted), w.dim_date.select(*wanted), "date_sk")


def _relative_period(w: Warehouse) -> DataFrame:
    as_of = w.stg_orders.agg(F.max("order_date")).first()[0]
    period = labels.relative_period(F.col("order_date"), as_of).alias("relative_period")
    return w.stg_orders.groupBy(period).agg(F.count("*").alias("num_orders"))


def _paged_results(w: Warehouse) -> DataFrame:
    order = [By("retail_price", True), "product_id"]
    shown = w.dim_product.select("product_id", "product_name", "retail_price")
    last = rows.page(shown, order, 15).collect()[-1]
    return rows.page(shown, order, 15, (last["retail_price"], last["product_id"]))


def _unlisted_items(w: Warehouse) -> DataFrame:
    return joins.orphans(w.raw.order_items, rows.has_competitor(w.dim_product), "product_id", name="unlisted_items")


def _sales_row_number(w: Warehouse) -> DataFrame:
    """The digest is sorted and written as its bytes, which sort like its lower-case digits and take half the room."""
    sales = w.fct_sales.select(F.unhex("sale_sk").alias("_digest"), "net_revenue")
    numbered = global_row_number(sales, [By("net_revenue", True), "_digest"], "position")
    return numbered.select(F.lower(F.hex("_digest")).alias("sale_sk"), "position")


def _sales_quantity_ntile(w: Warehouse, tiles: int = 10, name: str = "decile") -> DataFrame:
    return global_ntile(w.fct_sales.select("sale_sk", "quantity"), tiles, ["quantity", "sale_sk"], name).select("sale_sk", name)


def _rfm_high(w: Warehouse) -> DataFrame:
    totals = write_stable(analytics.customer_totals(w.fct_sales, AS_OF), "customer_totals", w.folder)
    return analytics.rfm_scores(totals, "high_is_best").select("customer_sk", "recency_score", "frequency_score", "monetary_score")


def _pivot_first_last(w: Warehouse) -> DataFrame:
    lines = w.fct_sales.join(w.dim_product.select("product_sk", "category"), "product_sk")
    keys = ["category", "order_status"]
    first = pivot.pivot_long(lines, keys[:1], keys[1:], "first", "order_item_id", order="order_item_id").withColumnRenamed("value", "first_value")
    last = pivot.pivot_long(lines, keys[:1], keys[1:], "last", "order_item_id", order="order_item_id").withColumnRenamed("value", "last_value")
    return first.join(last, keys)


def _cells(w: Warehouse, row: str, col: str, agg: str, value=None, totals: bool = True, scale: int | None = None) -> DataFrame:
    cells = dashboards.cross_table(w, [row], [col], agg, value, totals)
    return cells if scale is None else cells.withColumn("value", settle(F.col("value"), scale))


def _list_unique(w: Warehouse) -> DataFrame:
    cells = _cells(w, "age_group", "order_status", "list_unique", "country", False)
    return cells.withColumn("value", F.array_join("value", ", "))


def _two_columns(w: Warehouse) -> DataFrame:
    """Headings of two attributes, one of them missing for a fifth of the customers."""
    flat = dashboards.pivot_rows(w, columns=["order_year", "order_status", "age_group", "net_revenue"])
    flat = flat.withColumn("age_group", F.when(F.col("age_group") != "65+", F.col("age_group")))
    table = pivot.pivot_table(flat, ["order_year"], ["age_group", "order_status"], "sum", "net_revenue")
    headings = [c for c in table.columns if c != "order_year"]
    return table.unpivot("order_year", headings, "heading", "value").where("value is not null")


def _records(table: DataFrame) -> DataFrame:
    """Every row as a record and back, on the executors."""
    return rows.json_records(table).select(F.from_json("record", table.schema).alias("r")).select("r.*")


def _csv_mixed_headers(w: Warehouse) -> DataFrame:
    """A folder whose files name their columns in different orders."""
    path = f"{w.folder}/csv/mixed"
    names = w.raw.orders.columns
    even = F.crc32("order_id") % 2 == 0
    files.export_csv(w.raw.orders.where(even), path)
    other = w.raw.orders.where(~even).select(*reversed(names)).write.mode("append").option("header", True)
    other.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_csv(w.spark, path, schemas.ORDERS)


def _csv_multiline(w: Warehouse) -> DataFrame:
    """Orders whose payment method holds a line break and quotes, written and read by many tasks."""
    path = f"{w.folder}/csv/multiline"
    method = F.concat(F.lit('say "'), F.col("payment_method"), F.lit('"\n\ntwice'))
    files.export_csv(w.raw.orders.withColumn("payment_method", method), path)
    return files.read_csv(w.spark, path, schemas.ORDERS, multiline=True)


def _csv_renamed(w: Warehouse) -> DataFrame:
    """Orders under other headings, renamed while they are read, every cell quoted."""
    path = f"{w.folder}/csv/renamed"
    headings = {"Order No": "order_id", "CUSTOMER": "customer_id", "Day": "order_date"}
    named = w.raw.orders.withColumnsRenamed({column: heading for heading, column in headings.items()})
    files.export_csv(named, path, quote_all=True)
    return files.read_csv(w.spark, path, schemas.ORDERS, headings)


def _json_round_trip(w: Warehouse) -> DataFrame:
    path = f"{w.folder}/json/orders"
    files.export_json(w.raw.orders, path)
    return w.spark.read.schema(w.raw.orders.schema).json(path)


def _versioned_refresh(w: Warehouse) -> DataFrame:
    """Orders loaded, loaded again, and left as they are by a version that is not published."""
    table = Versions(w.spark, f"{w.folder}/versions/orders-{uuid.uuid4().hex[:8]}")
    for part in (w.raw.orders.limit(0), w.raw.orders):
        table.publish(table.write(part))
    table.write(w.raw.orders.select("order_id"))
    return table.read()


def _positions(w: Warehouse) -> DataFrame:
    return with_position(dashboards.top_products(w).select("product_name", "revenue"), [F.desc("revenue"), F.asc("product_name")])


def _materialized(w: Warehouse) -> DataFrame:
    shown = materialize(w.stg_orders.groupBy("order_status").agg(F.count("*").alias("num_orders")), "order_statuses")
    return shown.sparkSession.sql("SELECT order_status, num_orders FROM order_statuses")


def _defects(w: Warehouse) -> DataFrame:
    """Checks over raw tables with defects put in by key remainder, so that every one of them finds some."""
    items, orders, prices = w.raw.order_items, w.raw.orders, w.raw.competitor_prices
    n = F.substring("order_id", 4, 20).cast("bigint")
    items = items.withColumn("_n", n)
    items = items.withColumns(
        {
            "quantity": F.when(F.col("_n") % 89 == 0, -F.col("quantity")).otherwise(F.col("quantity")),
            "discount": F.when(F.col("_n") % 83 == 0, F.lit("1.5").cast("decimal(5,4)")).otherwise(F.col("discount")),
            "order_id": F.when(F.col("_n") % 97 == 0, "ORD-none").otherwise(F.col("order_id")),
            "product_id": F.when(F.col("_n") % 79 == 0, "PROD-none").otherwise(F.col("product_id")),
        }
    )
    items = items.unionByName(items.where(F.col("_n") % 101 == 0))
    orders = orders.withColumn("customer_id", F.when(n % 71 == 0, "CUST-none").otherwise(F.col("customer_id")))
    price = F.when(F.col("section").startswith("ECONOMY"), F.lit(0)).otherwise(F.col("competitor_price")).cast("decimal(10,2)")
    name = F.when(F.col("section").startswith("SMALL"), " ").otherwise(F.col("product_name"))
    return quality.all_checks(
        quality.check_unique(items, "raw_order_items", "order_item_id"),
        quality.check_rule(items, "raw_order_items", "quantity not positive", F.col("quantity") <= 0),
        quality.check_rule(items, "raw_order_items", "discount out of range", ~F.col("discount").between(0, 1)),
        quality.check_fk(items, "raw_order_items", "order_id", orders, "order_id"),
        quality.check_fk(items, "raw_order_items", "product_id", w.raw.products, "product_id"),
        quality.check_fk(orders, "raw_orders", "customer_id", w.raw.customers, "customer_id"),
        quality.check_scrape(prices.withColumns({"competitor_price": price, "product_name": name})),
    )


def _guarded(w: Warehouse) -> DataFrame:
    guarded.register_views({"fct_sales": w.fct_sales, "dim_customer": w.dim_customer})
    text = """SELECT region, count(DISTINCT customer_sk) AS customers, count(*) AS lines
              FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY region;"""
    answer = guarded.guarded_sql(w.spark, guarded.extract_statement(text))
    if answer.error:
        raise ValueError(answer.error)
    return answer.rows


def _guarded_truncated(w: Warehouse) -> DataFrame:
    """More rows than an answer may hold: the first ones, and the flag."""
    guarded.register_views({"fct_sales": w.fct_sales})
    text = "WITH lines AS (SELECT order_item_id, quantity FROM fct_sales) SELECT order_item_id, quantity FROM lines ORDER BY order_item_id"
    answer = guarded.guarded_sql(w.spark, text)
    if answer.error:
        raise ValueError(answer.error)
    return answer.rows.withColumn("truncated", F.lit(answer.truncated))


def _mix(df: DataFrame, column: str, name: str) -> DataFrame:
    return validation.distribution(df, column, name)


def _clv_tiers(w: Warehouse) -> DataFrame:
    return w.customer_lifetime_value.groupBy("clv_tier").agg(F.count("*").alias("customers"), F.sum("total_revenue").alias("total_revenue"))


# Query name -> function of the star schema.
REPORTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "stg_customers": lambda w: w.stg_customers,
    "stg_products": lambda w: w.stg_products,
    "stg_orders": lambda w: w.stg_orders,
    "stg_orders_trimmed": lambda w: staging.stg_orders(w.raw.orders, trim_first=True),
    "stg_order_items": lambda w: w.stg_order_items,
    "stg_order_items_clamped": lambda w: staging.stg_order_items(w.raw.order_items, clamp_revenue=True),
    "dim_customer": lambda w: w.dim_customer.drop("updated_at"),
    "dim_product": lambda w: w.dim_product.drop("updated_at"),
    "date_spine": lambda w: w.dim_date.select("date_actual"),
    "date_dim": lambda w: w.dim_date,
    "insert_missing_dates": _insert_missing_dates,
    "relative_period": _relative_period,
    "fct_sales": lambda w: w.sales(),
    "daily_revenue_trends": lambda w: analytics.daily_revenue_trends(w.fct_sales),
    "monthly_rollup": lambda w: analytics.monthly_rollup(analytics.daily_sales(w.fct_sales)),
    "monthly_rollup_calendar": lambda w: analytics.monthly_rollup(analytics.daily_sales(w.fct_sales), calendar=True),
    "monthly_rollup_every_month": lambda w: analytics.monthly_rollup(analytics.daily_sales(w.fct_sales), calendar=True),
    "mom_growth": lambda w: analytics.monthly_rollup(w.daily_revenue_trends).select("year", "month", "monthly_revenue", "prev_month_revenue", "mom_growth_pct"),
    "ytd_revenue": lambda w: analytics.ytd_revenue(analytics.daily_sales(w.fct_sales)).select("order_date", "net_revenue", "ytd_revenue"),
    "top_product_categories": lambda w: analytics.top_product_categories(w.fct_sales, w.dim_product, w.hot_products),
    "customer_lifetime_value": lambda w: analytics.customer_lifetime_value(w.fct_sales, w.dim_customer, AS_OF, folder=w.folder),
    "rfm_high_is_best": _rfm_high,
    "surrogate_key": lambda w: w.raw.order_items.select("order_item_id", surrogate_key("order_id", "discount").alias("line_key")),
    "sales_row_number": _sales_row_number,
    "sales_quantity_ntile": _sales_quantity_ntile,
    "sales_ntile_100": lambda w: _sales_quantity_ntile(w, 100, "percentile"),
    "price_tier_mix": lambda w: _mix(w.stg_products, "price_tier", "products"),
    "tenure_segment_mix": lambda w: _mix(w.dim_customer, "customer_segment", "customers"),
    "region_mix": lambda w: _mix(w.dim_customer, "region", "customers"),
    "clv_tier_mix": _clv_tiers,
    "parse_price": _parse_price,
    "lenient_dates": _lenient_dates,
    "json_records": lambda w: rows.json_records(_mix(w.dim_customer, "region", "customers")),
    "csv_round_trip": _csv_round_trip,
    "load_report": _load_report,
    "null_profile_customers": lambda w: validation.null_profile(w.raw.customers, ["customer_id", "full_name", "email", "country"]),
    "null_profile_products": lambda w: validation.null_profile(w.raw.products, ["product_id", "product_name", "retail_price", "base_cost"]),
    "null_profile_items": lambda w: validation.null_profile(w.raw.order_items, ["order_item_id", "discount"]),
    "duplicate_keys": lambda w: validation.duplicate_keys(w.raw.products, "product_name"),
    "duplicate_ids": _duplicate_ids,
    "orphan_orders": lambda w: joins.orphans(w.raw.orders, w.raw.customers, "customer_id", name="orphan_orders"),
    "orphan_items_orders": lambda w: joins.orphans(w.raw.order_items, w.raw.orders, "order_id", name="orphan_items_orders"),
    "orphan_items_products": lambda w: joins.orphans(w.raw.order_items, w.raw.products, "product_id", name="orphan_items_products"),
    "unlisted_items": _unlisted_items,
    "cost_exceeds_retail": lambda w: validation.cost_exceeds_retail(w.raw.products),
    "out_of_range_orders": lambda w: validation.out_of_range_orders(w.raw.orders, dt.date(1996, 1, 1), dt.date(1996, 12, 31)),
    "invalid_quantity": lambda w: validation.invalid_quantity(w.raw.order_items),
    "invalid_discount": lambda w: validation.invalid_discount(w.raw.order_items),
    "category_revenue_staging": lambda w: validation.category_revenue_staging(w.raw.order_items, w.raw.products),
    "orders_by_month": lambda w: validation.orders_by_month(w.raw.orders),
    "country_distribution": lambda w: _mix(w.raw.customers, "country", "num_customers"),
    "payment_distribution": lambda w: validation.distribution(w.raw.orders, "payment_method", "num_orders", share=True),
    "status_distribution": lambda w: _mix(w.raw.orders, "order_status", "num_orders"),
    "distinct_counts": lambda w: validation.count_distinct(w.fct_sales, ["payment_method"], ["order_id", "customer_sk"]),
    "fact_grain_check": lambda w: quality.check_grain(w.fct_sales, "order_item_id"),
    "revenue_sanity": lambda w: validation.revenue_sanity(w.fct_sales),
    "dimension_coverage": validation.dimension_coverage,
    "scrape_validation": lambda w: quality.check_scrape(w.raw.competitor_prices),
    "dq_defects": _defects,
    "dq_unique": model_tests.unique_tests,
    "dq_not_null": model_tests.not_null_tests,
    "dq_accepted_values": model_tests.accepted_value_tests,
    "dq_relationships": model_tests.relationship_tests,
    "dashboard_kpis": dashboards.dashboard_kpis,
    "kpi_cards": lambda w: dashboards.format_kpis(dashboards.dashboard_kpis(w)),
    "dashboard_monthly": dashboards.dashboard_monthly,
    "top_categories_5": dashboards.top_categories,
    "top_products_5": dashboards.top_products_short,
    "daily_series": dashboards.daily_series,
    "monthly_revenue": dashboards.monthly_revenue,
    "monthly_table": dashboards.monthly_table,
    "category_summary": dashboards.category_summary,
    "top_products_20": dashboards.top_products,
    "competitor_scatter": dashboards.competitor_scatter,
    "price_position": dashboards.price_position,
    "product_kpis": dashboards.product_kpis,
    "top_customers": dashboards.top_customers,
    "top_customers_by_key": lambda w: dashboards.top_customers(w, by_key=True).drop("avg_order_value", "segment"),
    "clv_segments": dashboards.clv_segments,
    "age_group_revenue": dashboards.age_group_revenue,
    "age_group_revenue_by_customer": lambda w: dashboards.age_group_revenue(w, weighting="customer"),
    "payment_method_lines": dashboards.payment_method_lines,
    "registration_trend": dashboards.registration_trend,
    "customer_kpis": dashboards.customer_kpis,
    "customer_kpis_all": lambda w: dashboards.customer_kpis(w, over="all"),
    "customer_search": lambda w: rows.search(w.dim_customer.select("customer_sk", "customer_id", "full_name", "city", "age_group"), "Nation_1", ["full_name", "city", "age_group"]),
    "category_filter": lambda w: rows.category_filter(w.dim_product.select("product_id", "product_name", "category"), "ECON"),
    "paged_results": _paged_results,
    "pivot_rows": dashboards.pivot_rows,
    "pivot_revenue_category_month": lambda w: pivot.pivot_table(dashboards.pivot_rows(w, columns=["category", "order_month", "net_revenue"]), ["category"], ["order_month"], "sum", "net_revenue", headings=MONTHS),
    "pivot_orders_age_payment": lambda w: dashboards.preset(w, "orders_by_age_payment"),
    "pivot_margin_category": lambda w: dashboards.preset(w, "margin_by_category"),
    "pivot_revenue_city_age": lambda w: dashboards.preset(w, "clv_by_city"),
    "pivot_with_totals": lambda w: _cells(w, "category", "payment_method", "sum", "net_revenue"),
    "pivot_average_totals": lambda w: _cells(w, "age_group", "order_quarter", "average", "margin_pct"),
    "pivot_count_unique": lambda w: _cells(w, "country", "order_year", "count_unique", "city"),
    "pivot_median": lambda w: _cells(w, "category", "order_quarter", "median", "net_revenue"),
    "pivot_min": lambda w: _cells(w, "category", "order_status", "min", "unit_price"),
    "pivot_max": lambda w: _cells(w, "category", "order_status", "max", "unit_price"),
    "pivot_sum_over_sum": lambda w: _cells(w, "category", "order_status", "sum_over_sum", ("gross_profit", "net_revenue")),
    "pivot_sample_stdev": lambda w: _cells(w, "category", "order_status", "sample_stdev", "net_revenue", scale=3),
    "pivot_sample_variance": lambda w: _cells(w, "category", "order_status", "sample_variance", "quantity", scale=6),
    "pivot_list_unique": _list_unique,
    "pivot_first_last": _pivot_first_last,
    "pivot_share_of_total": lambda w: _cells(w, "category", "payment_method", "fraction_of_total", "net_revenue", False),
    "pivot_share_of_row": lambda w: _cells(w, "category", "payment_method", "fraction_of_row", "net_revenue", False),
    "pivot_count_share_of_total": lambda w: _cells(w, "category", "payment_method", "count_fraction_of_total", None, False),
    "pivot_count_share_of_row": lambda w: _cells(w, "category", "payment_method", "count_fraction_of_row", None, False),
    "pivot_count_share_of_column": lambda w: _cells(w, "category", "payment_method", "count_fraction_of_column", None, False),
    "pivot_two_columns": _two_columns,
    "unique_values": lambda w: pivot.unique_values(dashboards.pivot_rows(w, columns=["category", "country"]), ["category"], [], "country"),
    "records_all": lambda w: _records(w.stg_orders.select("order_id", "customer_id", "order_date", "order_status", "payment_method")),
    "records_round_trip": lambda w: _records(w.stg_orders.select("order_id", "order_date", "order_status")),
    "csv_mixed_headers": _csv_mixed_headers,
    "csv_multiline_split": _csv_multiline,
    "csv_renamed_columns": _csv_renamed,
    "json_round_trip": _json_round_trip,
    "versioned_refresh": _versioned_refresh,
    "top_product_positions": _positions,
    "materialized_view": _materialized,
    "sample_lines": lambda w: rows.sample_rows(w.fct_sales.select("sale_sk", "quantity"), 100, [By("quantity", True), "sale_sk"]),
    "dq_row_tests": model_tests.row_tests,
    "dq_model_tests": model_tests.model_tests,
    "pivot_share_of_column": lambda w: _cells(w, "category", "payment_method", "fraction_of_column", "net_revenue", False),
    "ask_top_customers": questions.ask_top_customers,
    "top_customers_5": lambda w: questions.ask_top_customers(w, 5),
    "ask_monthly_trend": questions.ask_monthly_trend,
    "ask_category_performance": questions.ask_category_performance,
    "ask_competitor_prices": questions.ask_competitor_prices,
    "ask_default_monthly": questions.ask_default_monthly,
    "highest_margin_categories": questions.highest_margin_categories,
    "highest_margin_products": lambda w: questions.highest_margin_products(w, "ECONOMY"),
    "revenue_by_region": lambda w: questions.revenue_by(w, "region"),
    "revenue_by_age_group": lambda w: questions.revenue_by(w, "age_group"),
    "lapsed_customers": questions.lapsed_customers,
    "lapsed_customers_revenue": lambda w: questions.lapsed_customers(w, 180, only_revenue=True),
    "aov_by_payment_method": questions.aov_by_payment_method,
    "priced_above_competitor": questions.priced_above_competitor,
    "monthly_trend_year": lambda w: questions.monthly_trend_year(w, 1996),
    "last_6_months": lambda w: questions.last_months(w, AS_OF),
    "guarded_sql_ok": _guarded,
    "guarded_sql_truncated": _guarded_truncated,
}


def _query(report: Callable[[Warehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: doubles(report(warehouse(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query as a function of session and data folder."""
    named = {name: _query(report) for name, report in REPORTS.items()}
    named["html_table_extract"] = lambda spark, folder: doubles(_html_table_extract(spark, folder))
    named["row_count_reconciliation"] = lambda spark, folder: _row_counts(spark, folder, warehouse(spark, folder))
    if llm_queries:
        named.update(llm_queries.queries(), pipeline=corpus_pipeline.run)
    return named


def oracle_sql() -> dict[str, str]:
    """DuckDB statement per query, over the same parquet tables."""
    statements = oracle_statements()
    if llm_queries:
        statements.update(llm_queries.oracle_sql())
        if corpus_pipeline.ORACLE_SQL:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements


def entry(spark: SparkSession) -> DataFrame:
    """Daily revenue with running year total, month totals and growth."""
    return queries()["daily_revenue_trends"](spark, "/root/testdata/sf0.001")

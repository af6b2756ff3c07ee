"""DuckDB statement per registered query, in the query's column names."""

from __future__ import annotations

from checks.tables import AS_OF, dbl, mean, ratio, with_tables

CLV_COLUMNS = f"""customer_sk, customer_id, full_name, email, city, country, region, age_group, customer_segment,
    total_orders, total_items, {dbl('total_revenue', 'total_profit')}, first_order_date, last_order_date, active_days,
    days_since_last_order, {dbl('avg_item_value')}, recency_score, frequency_score, monetary_score, rfm_total, clv_tier"""

FACT_MONEY = dbl(
    "unit_price", "discount", "gross_revenue", "net_revenue", "cogs", "gross_profit", "margin_pct", "competitor_price", "price_delta"
)

SEASON = "CASE WHEN month(d) IN (12, 1, 2) THEN 'Winter' WHEN month(d) IN (3, 4, 5) THEN 'Spring' WHEN month(d) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"
LAST_DAY = "(SELECT max(order_date) FROM stg_orders)"


def relative(day: str, as_of: str) -> str:
    return f"""CASE WHEN {day} = {as_of} THEN 'Today' WHEN {day} = {as_of} - 1 THEN 'Yesterday'
        WHEN {day} >= date_trunc('week', {as_of}) THEN 'This Week' WHEN {day} >= date_trunc('month', {as_of}) THEN 'This Month'
        ELSE 'Prior' END"""


TOP_CUSTOMERS = f"""SELECT full_name, city, age_group, count(DISTINCT order_id) AS total_orders, round(sum(net_revenue), 0) AS total_revenue,
    {ratio('sum(net_revenue)', 'count(DISTINCT order_id)')} AS avg_order_value,
    CASE WHEN sum(net_revenue) > 15000 THEN 'VIP' WHEN sum(net_revenue) > 8000 THEN 'High Value'
         WHEN sum(net_revenue) > 4000 THEN 'Mid Value' ELSE 'Standard' END AS segment
    FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY full_name, city, age_group"""
TOP_25 = f"{TOP_CUSTOMERS} ORDER BY total_revenue DESC, full_name, city, age_group LIMIT 25"

TOP_20 = f"""SELECT product_name, category, round(sum(net_revenue), 0) AS revenue, CAST(sum(quantity) AS BIGINT) AS units_sold,
    {mean('margin_pct', 1)} AS avg_margin, {mean('unit_price', 2)} AS avg_price,
    {mean('dim_product.avg_competitor_price', 2)} AS competitor_price
    FROM fct_sales JOIN dim_product USING (product_sk) GROUP BY product_name, category
    ORDER BY revenue DESC, product_name, category LIMIT 20"""

CATEGORY_SUMMARY = f"""SELECT category, round(sum(net_revenue), 0) AS revenue, CAST(sum(quantity) AS BIGINT) AS units,
    {mean('margin_pct', 1)} AS avg_margin FROM fct_sales JOIN dim_product USING (product_sk) GROUP BY category"""

CUSTOMER_VALUE = "SELECT customer_sk, sum(net_revenue) AS clv, count(*) AS lines FROM fct_sales GROUP BY customer_sk"


def check_row(check: str, table: str, column: str, failures: str) -> str:
    return f"""SELECT '{check}' AS "check", '{table}' AS "table", '{column}' AS "column",
        CAST(({failures}) AS BIGINT) AS failures, ({failures}) = 0 AS passed"""


DEFECT_ITEMS = """(SELECT *, CAST(substr(order_id, 4) AS BIGINT) AS n FROM raw_items UNION ALL
    SELECT *, CAST(substr(order_id, 4) AS BIGINT) AS n FROM raw_items WHERE CAST(substr(order_id, 4) AS BIGINT) % 101 = 0)"""

# Table names of the checks -> definitions above.
CHECKED = {
    "raw_order_items": "raw_items",
    "stg_order_items": "stg_items",
    "daily_revenue_trends": "trends",
    "customer_lifetime_value": "clv",
    "top_product_categories": "categories",
}


# Table -> columns that must be unique.
UNIQUE = {
    "raw_customers": ["customer_id"],
    "raw_products": ["product_id"],
    "raw_orders": ["order_id"],
    "raw_order_items": ["order_item_id"],
    "stg_customers": ["customer_id"],
    "stg_products": ["product_id"],
    "stg_orders": ["order_id"],
    "stg_order_items": ["order_item_id"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "product_id"],
    "fct_sales": ["order_item_id"],
    "daily_revenue_trends": ["order_date"],
    "customer_lifetime_value": ["customer_sk"],
}

# Table -> columns that must be filled.
NOT_NULL = {
    "raw_customers": ["customer_id", "email", "country"],
    "raw_products": ["product_id", "retail_price"],
    "raw_orders": ["order_id", "customer_id"],
    "raw_order_items": ["order_item_id", "order_id", "product_id"],
    "stg_customers": ["customer_id", "email"],
    "stg_products": ["product_id", "retail_price", "base_cost"],
    "stg_orders": ["order_id", "customer_id"],
    "stg_order_items": ["order_item_id", "order_id", "product_id", "quantity", "unit_price"],
    "dim_customer": ["customer_sk", "customer_id"],
    "dim_product": ["product_sk", "product_id", "gross_margin_pct"],
    "fct_sales": ["order_item_id", "order_id", "customer_sk", "product_sk", "quantity", "net_revenue"],
    "daily_revenue_trends": ["order_date"],
    "customer_lifetime_value": ["customer_sk"],
    "top_product_categories": ["category"],
}

# Table, column and its accepted values.
ACCEPTED = [
    ("stg_customers", "gender", ["MALE", "FEMALE", "NON-BINARY"]),
    ("stg_customers", "age_group", ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]),
    ("stg_products", "price_tier", ["Budget", "Mid-range", "Premium", "Luxury"]),
    ("stg_orders", "order_status", ["Completed", "Shipped", "Processing", "Cancelled", "Returned"]),
    ("dim_customer", "region", ["North America", "Europe", "APAC", "Middle East", "Other"]),
    ("dim_customer", "customer_segment", ["New", "Regular", "Loyal"]),
    ("customer_lifetime_value", "clv_tier", ["Champions", "Loyal", "Potential Loyal", "Recent", "At Risk", "Hibernating"]),
]

# Child table, column, parent table, column.
RELATIONSHIPS = [
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("stg_order_items", "product_id", "stg_products", "product_id"),
    ("fct_sales", "customer_sk", "dim_customer", "customer_sk"),
    ("fct_sales", "product_sk", "dim_product", "product_sk"),
]


def _checks() -> dict[str, str]:
    def source(name: str) -> str:
        return CHECKED.get(name, name)

    unique = [
        check_row("unique", t, c, f"SELECT count(*) FROM (SELECT {c} FROM {source(t)} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)")
        for t, columns in UNIQUE.items() for c in columns
    ]
    filled = [
        check_row("not_null", t, c, f"SELECT count(*) FROM {source(t)} WHERE {c} IS NULL")
        for t, columns in NOT_NULL.items() for c in columns
    ]
    accepted = [
        check_row("accepted_values", t, c, "SELECT count(DISTINCT {0}) FROM {1} WHERE {0} NOT IN ({2})".format(
            c, source(t), ", ".join(f"'{v}'" for v in values)))
        for t, c, values in ACCEPTED
    ]
    related = [
        check_row("relationships", t, c, f"SELECT count(*) FROM {source(t)} x WHERE x.{c} IS NOT NULL AND NOT EXISTS "
                                         f"(SELECT 1 FROM {source(p)} y WHERE y.{k} = x.{c})")
        for t, c, p, k in RELATIONSHIPS
    ]
    return {
        "dq_unique": " UNION ALL ".join(unique),
        "dq_not_null": " UNION ALL ".join(filled),
        "dq_accepted_values": " UNION ALL ".join(accepted),
        "dq_relationships": " UNION ALL ".join(related),
        "dq_row_tests": " UNION ALL ".join([*filled, *accepted]),
        "dq_model_tests": " UNION ALL ".join([*unique, *filled, *accepted, *related]),
    }


def cell_totals(rows: str, cols: str, value: str, where: str = "") -> str:
    """Cells, row totals, column totals and the grand total of two attributes."""
    def level(r: str, c: str, keys: str) -> str:
        return f"SELECT {r} AS {rows}, {c} AS {cols}, {value} AS value FROM flat {where} {'GROUP BY ' + keys if keys else ''}"

    return " UNION ALL ".join([
        level(rows, cols, f"{rows}, {cols}"), level(rows, "'Totals'", rows), level("'Totals'", cols, cols), level("'Totals'", "'Totals'", ""),
    ])


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MONTH_CELLS = ", ".join(f"CAST(sum(net_revenue) FILTER (WHERE order_month = '{m}') AS DOUBLE) AS \"{m}\"" for m in MONTHS)
MONTH_TABLE = f"SELECT {{0}} AS category, {MONTH_CELLS}, CAST(sum(net_revenue) AS DOUBLE) AS \"Totals\" FROM flat"

PRICE_TEXT = """SELECT product_id, CASE category WHEN 'ECONOMY' THEN concat(' € ', CAST(retail_price AS VARCHAR))
    WHEN 'SMALL' THEN 'N/A' WHEN 'PROMO' THEN concat('1.', CAST(retail_price AS VARCHAR))
    ELSE '$' || format('{:,.2f}', CAST(retail_price AS DOUBLE)) END AS price_text FROM raw_products"""

STATEMENTS = {
    # Staging tables, marts, analytics
    "stg_customers": "SELECT * FROM stg_customers",
    "stg_products": f"SELECT * EXCLUDE (retail_price, base_cost, gross_margin_pct), {dbl('retail_price', 'base_cost', 'gross_margin_pct')} FROM stg_products",
    "stg_orders": "SELECT * FROM stg_orders",
    "stg_orders_trimmed": "SELECT * EXCLUDE (is_revenue_order), order_status IN ('Completed', 'Shipped') AS is_revenue_order FROM stg_orders",
    "stg_order_items": f"SELECT order_item_id, order_id, product_id, quantity, {dbl('unit_price', 'discount', 'gross_revenue', 'net_revenue')} FROM stg_items",
    "stg_order_items_clamped": f"""SELECT order_item_id, order_id, product_id, quantity, {dbl('unit_price', 'discount', 'gross_revenue')},
        CAST(round(quantity * unit_price * (1 - discount), 2) AS DOUBLE) AS net_revenue FROM stg_items""",
    "dim_customer": "SELECT * FROM dim_customer",
    "dim_product": f"""SELECT product_sk, product_id, category, subcategory, product_name, supplier_name, price_tier,
        {dbl('retail_price', 'base_cost', 'gross_margin_pct', 'avg_competitor_price', 'price_vs_competitor')} FROM dim_product""",
    "date_spine": "SELECT d AS date_actual FROM spine",
    "date_dim": f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, d AS date_actual, CAST(year(d) AS INTEGER) AS year,
        CAST(quarter(d) AS INTEGER) AS quarter_of_year, CAST(month(d) AS INTEGER) AS month_of_year, strftime(d, '%b') AS month_name,
        CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, strftime(d, '%a') AS day_name,
        CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
        concat('Q', CAST(quarter(d) AS VARCHAR)) AS quarter_label, strftime(d, '%b %Y') AS month_year_label,
        strftime(d, '%Y-%m') AS year_month, dayofweek(d) IN (0, 6) AS is_weekend, dayofweek(d) NOT IN (0, 6) AS is_weekday,
        FALSE AS is_holiday, {SEASON} AS season, CAST(year(d) AS INTEGER) AS fiscal_year, CAST(quarter(d) AS INTEGER) AS fiscal_quarter,
        concat('Q', CAST(quarter(d) AS VARCHAR), ' ', CAST(year(d) AS VARCHAR)) AS fiscal_label,
        {relative('d', AS_OF)} AS relative_period FROM spine""",
    "insert_missing_dates": f"SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, d AS date_actual, {SEASON} AS season FROM spine",
    "relative_period": f"SELECT {relative('order_date', LAST_DAY)} AS relative_period, count(*) AS num_orders FROM stg_orders GROUP BY 1",
    "fct_sales": f"""SELECT sale_sk, order_item_id, order_id, order_date_sk, order_date, customer_sk, product_sk, payment_method,
        order_status, is_revenue_order, quantity, {FACT_MONEY} FROM fct_sales""",
    "daily_revenue_trends": f"""SELECT order_date, year, month, month_name, quarter, num_orders, num_items, {dbl(
        'net_revenue', 'gross_revenue', 'gross_profit', 'margin_pct', 'ytd_revenue', 'monthly_revenue', 'monthly_profit')}, monthly_orders,
        {dbl('avg_margin_pct', 'prev_month_revenue', 'mom_growth_pct')} FROM trends""",
    "monthly_rollup_calendar": f"""SELECT year, month, month_name, quarter, monthly_orders, {dbl('monthly_revenue', 'monthly_profit', 'avg_margin_pct', 'prev_month_revenue')},
        CAST({ratio('monthly_revenue - prev_month_revenue', 'prev_month_revenue', 2, 100)} AS DOUBLE) AS mom_growth_pct FROM (
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, strftime(d, '%b') AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
            coalesce(m.monthly_orders, 0) AS monthly_orders, coalesce(m.monthly_revenue, 0) AS monthly_revenue, coalesce(m.monthly_profit, 0) AS monthly_profit,
            m.avg_margin_pct, lag(coalesce(m.monthly_revenue, 0)) OVER (ORDER BY d) AS prev_month_revenue
        FROM (SELECT CAST(unnest(generate_series(min(make_date(year, month, 1)), max(make_date(year, month, 1)), INTERVAL 1 MONTH)) AS DATE) AS d
              FROM months) LEFT JOIN months m ON m.year = year(d) AND m.month = month(d))""",
    "monthly_rollup_every_month": f"""SELECT year, month, month_name, quarter, monthly_orders, {dbl('monthly_revenue', 'monthly_profit', 'avg_margin_pct', 'prev_month_revenue')},
        CAST({ratio('monthly_revenue - prev_month_revenue', 'prev_month_revenue', 2, 100)} AS DOUBLE) AS mom_growth_pct FROM (
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, strftime(d, '%b') AS month_name, CAST(quarter(d) AS INTEGER) AS quarter,
            coalesce(m.monthly_orders, 0) AS monthly_orders, coalesce(m.monthly_revenue, 0) AS monthly_revenue, coalesce(m.monthly_profit, 0) AS monthly_profit,
            m.avg_margin_pct, lag(coalesce(m.monthly_revenue, 0)) OVER (ORDER BY d) AS prev_month_revenue
        FROM (SELECT CAST(unnest(generate_series(min(make_date(year, month, 1)), max(make_date(year, month, 1)), INTERVAL 1 MONTH)) AS DATE) AS d
              FROM months) LEFT JOIN months m ON m.year = year(d) AND m.month = month(d))""",
    "monthly_rollup": f"""SELECT year, month, month_name, quarter, monthly_orders, {dbl(
        'monthly_revenue', 'monthly_profit', 'avg_margin_pct', 'prev_month_revenue', 'mom_growth_pct')} FROM monthly""",
    "mom_growth": f"SELECT year, month, {dbl('monthly_revenue', 'prev_month_revenue', 'mom_growth_pct')} FROM monthly",
    "ytd_revenue": f"SELECT order_date, {dbl('net_revenue', 'ytd_revenue')} FROM daily",
    "top_product_categories": f"""SELECT category, subcategory, num_products, num_orders, num_items_sold, total_units_sold,
        revenue_rank, profit_rank, {dbl('total_revenue', 'total_profit', 'avg_margin_pct', 'avg_selling_price',
        'revenue_per_order', 'revenue_share_pct')} FROM categories""",
    "customer_lifetime_value": f"SELECT {CLV_COLUMNS} FROM clv",
    "rfm_high_is_best": "SELECT customer_sk, recency_score, frequency_score, monetary_score FROM rfm_high",
    "surrogate_key": """SELECT order_item_id, md5(concat_ws('-', order_id, coalesce(CAST(discount AS VARCHAR),
        '_dbt_utils_surrogate_key_null_'))) AS line_key FROM raw_items""",
    "sales_row_number": """SELECT sale_sk, row_number() OVER (ORDER BY net_revenue DESC, sale_sk) AS position FROM fct_sales""",
    "sales_ntile_100": "SELECT sale_sk, CAST(ntile(100) OVER (ORDER BY quantity, sale_sk) AS INTEGER) AS percentile FROM fct_sales",
    "sales_quantity_ntile": "SELECT sale_sk, CAST(ntile(10) OVER (ORDER BY quantity, sale_sk) AS INTEGER) AS decile FROM fct_sales",
    # Mixes and text
    "price_tier_mix": "SELECT price_tier, count(*) AS products FROM stg_products GROUP BY price_tier",
    "tenure_segment_mix": "SELECT customer_segment, count(*) AS customers FROM dim_customer GROUP BY customer_segment",
    "region_mix": "SELECT region, count(*) AS customers FROM dim_customer GROUP BY region",
    "clv_tier_mix": f"SELECT clv_tier, count(*) AS customers, CAST(sum(total_revenue) AS DOUBLE) AS total_revenue FROM clv GROUP BY clv_tier",
    "parse_price": f"""SELECT product_id, price_text, coalesce(try_cast(regexp_replace(price_text, '[^0-9.]', '', 'g') AS DOUBLE), 0.0) AS price
        FROM ({PRICE_TEXT})""",
    "lenient_dates": """SELECT order_id, try_cast(CASE payment_method WHEN '1-URGENT ' THEN strftime(order_date, '%Y-13-%d')
        WHEN '5-LOW ' THEN 'unknown' ELSE strftime(order_date, '%Y-%m-%d') END AS DATE) AS order_date FROM raw_orders""",
    "html_table_extract": """SELECT product_name, subcategory AS category, category AS section,
        CAST(retail_price AS DOUBLE) AS competitor_price, 'In Stock' AS stock_status FROM raw_products""",
    "json_records": "SELECT CAST(to_json({region: region, customers: count(*)}) AS VARCHAR) AS record FROM dim_customer GROUP BY region",
    "csv_round_trip": "SELECT * FROM raw_orders",
    "csv_mixed_headers": "SELECT * FROM raw_orders",
    "csv_multiline_split": """SELECT * REPLACE ('say "' || payment_method || '"' || chr(10) || chr(10) || 'twice' AS payment_method) FROM raw_orders""",
    "csv_renamed_columns": "SELECT * FROM raw_orders",
    "json_round_trip": "SELECT * FROM raw_orders",
    "versioned_refresh": "SELECT * FROM raw_orders",
    "top_product_positions": f"""SELECT product_name, CAST(revenue AS DOUBLE) AS revenue, CAST(row_number() OVER (ORDER BY revenue DESC, product_name) AS INTEGER) AS position
        FROM ({TOP_20})""",
    "materialized_view": "SELECT order_status, count(*) AS num_orders FROM stg_orders GROUP BY order_status",
    "sample_lines": "SELECT sale_sk, quantity FROM fct_sales ORDER BY quantity DESC NULLS LAST, sale_sk LIMIT 100",
    "load_report": """SELECT * FROM (VALUES ('missing', 'FAILED', CAST(0 AS BIGINT))) t(table_name, status, rows)
        UNION ALL SELECT 'customers', 'SUCCESS', count(*) FROM customer UNION ALL SELECT 'products', 'SUCCESS', count(*) FROM part
        UNION ALL SELECT 'orders', 'SUCCESS', count(*) FROM orders UNION ALL SELECT 'order_items', 'SUCCESS', count(*) FROM lineitem
        UNION ALL SELECT 'competitor_prices', 'SUCCESS', count(*) FROM raw_prices""",
    # Validation
    "row_count_reconciliation": """SELECT 'customers' AS table_name, count(*) AS row_count, count(*) AS expected, TRUE AS matches FROM customer
        UNION ALL SELECT 'products', count(*), count(*), TRUE FROM part UNION ALL SELECT 'orders', count(*), count(*), TRUE FROM orders
        UNION ALL SELECT 'order_items', count(*), count(*), TRUE FROM lineitem
        UNION ALL SELECT 'competitor_prices', count(*), NULL, TRUE FROM raw_prices""",
    "null_profile_customers": """SELECT count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_id,
        count(*) FILTER (WHERE full_name IS NULL) AS null_full_name, count(*) FILTER (WHERE email IS NULL) AS null_email,
        count(*) FILTER (WHERE country IS NULL) AS null_country, count(*) AS total_rows FROM raw_customers""",
    "null_profile_products": """SELECT count(*) FILTER (WHERE product_id IS NULL) AS null_product_id,
        count(*) FILTER (WHERE product_name IS NULL) AS null_product_name, count(*) FILTER (WHERE retail_price IS NULL) AS null_retail_price,
        count(*) FILTER (WHERE base_cost IS NULL) AS null_base_cost, count(*) AS total_rows FROM raw_products""",
    "null_profile_items": """SELECT count(*) FILTER (WHERE order_item_id IS NULL) AS null_order_item_id,
        count(*) FILTER (WHERE discount IS NULL) AS null_discount, count(*) AS total_rows FROM raw_items""",
    "duplicate_keys": "SELECT product_name, count(*) AS cnt FROM raw_products GROUP BY product_name HAVING count(*) > 1 ORDER BY product_name LIMIT 10",
    "duplicate_ids": """SELECT 'order_items' AS table_name, order_item_id AS key, count(*) AS cnt FROM raw_items GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'orders', order_id, count(*) FROM raw_orders GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'customers', customer_id, count(*) FROM raw_customers GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'products', product_id, count(*) FROM raw_products GROUP BY 2 HAVING count(*) > 1""",
    "orphan_orders": "SELECT count(*) AS orphan_orders FROM raw_orders o LEFT JOIN raw_customers c USING (customer_id) WHERE c.full_name IS NULL",
    "orphan_items_orders": "SELECT count(*) AS orphan_items_orders FROM raw_items i LEFT JOIN raw_orders o USING (order_id) WHERE o.order_status IS NULL",
    "orphan_items_products": "SELECT count(*) AS orphan_items_products FROM raw_items i LEFT JOIN raw_products p USING (product_id) WHERE p.product_name IS NULL",
    "unlisted_items": """SELECT count(*) AS unlisted_items FROM raw_items i WHERE NOT EXISTS
        (SELECT 1 FROM dim_product p WHERE p.product_id = i.product_id AND avg_competitor_price IS NOT NULL)""",
    "cost_exceeds_retail": "SELECT count(*) AS cost_exceeds_retail FROM raw_products WHERE base_cost >= retail_price",
    "out_of_range_orders": "SELECT count(*) AS out_of_range_orders FROM raw_orders WHERE order_date < DATE '1996-01-01' OR order_date > DATE '1996-12-31'",
    "invalid_quantity": "SELECT count(*) AS invalid_quantity FROM raw_items WHERE quantity <= 0",
    "invalid_discount": "SELECT count(*) AS invalid_discount FROM raw_items WHERE discount < 0 OR discount > 1",
    "category_revenue_staging": f"""SELECT category, count(DISTINCT order_id) AS num_orders, CAST(sum(quantity * unit_price) AS DOUBLE) AS gross_revenue,
        CAST({mean('unit_price', 2)} AS DOUBLE) AS avg_unit_price FROM raw_items JOIN raw_products USING (product_id) GROUP BY category""",
    "orders_by_month": """SELECT CAST(month(order_date) AS INTEGER) AS month_num, strftime(order_date, '%b') AS month_name, count(*) AS order_count
        FROM raw_orders GROUP BY 1, 2""",
    "country_distribution": "SELECT country, count(*) AS num_customers FROM raw_customers GROUP BY country",
    "payment_distribution": f"""SELECT payment_method, count(*) AS num_orders, CAST({ratio('count(*)', 'sum(count(*)) OVER ()', 2, 100)} AS DOUBLE) AS pct
        FROM raw_orders GROUP BY payment_method""",
    "status_distribution": "SELECT order_status, count(*) AS num_orders FROM raw_orders GROUP BY order_status",
    "distinct_counts": """SELECT payment_method, count(DISTINCT order_id) AS distinct_order_id, count(DISTINCT customer_sk) AS distinct_customer_sk
        FROM fct_sales GROUP BY payment_method""",
    "fact_grain_check": "SELECT count(*) AS fct_rows, count(DISTINCT order_item_id) AS unique_items FROM fct_sales",
    "revenue_sanity": f"""SELECT CAST(round(sum(net_revenue), 2) AS DOUBLE) AS total_net_revenue,
        CAST({mean('net_revenue', 2)} AS DOUBLE) AS avg_order_item_revenue, CAST(round(sum(gross_profit), 2) AS DOUBLE) AS total_gross_profit,
        CAST({mean('margin_pct', 2)} AS DOUBLE) AS avg_margin_pct FROM fct_sales WHERE order_status = 'Completed'""",
    "dimension_coverage": """SELECT (SELECT count(DISTINCT customer_sk) FROM fct_sales) AS customers_in_fact,
        (SELECT count(*) FROM dim_customer) AS total_dim_customers, (SELECT count(DISTINCT product_sk) FROM fct_sales) AS products_in_fact,
        (SELECT count(*) FROM dim_product) AS total_dim_products""",
    "dq_defects": " UNION ALL ".join([
        check_row("unique", "raw_order_items", "order_item_id", f"SELECT count(*) FROM (SELECT 1 FROM {DEFECT_ITEMS} GROUP BY order_item_id HAVING count(*) > 1)"),
        check_row("rule", "raw_order_items", "quantity not positive", f"SELECT count(*) FROM {DEFECT_ITEMS} WHERE n % 89 = 0"),
        check_row("rule", "raw_order_items", "discount out of range", f"SELECT count(*) FROM {DEFECT_ITEMS} WHERE n % 83 = 0"),
        check_row("relationships", "raw_order_items", "order_id", f"SELECT count(*) FROM {DEFECT_ITEMS} WHERE n % 97 = 0"),
        check_row("relationships", "raw_order_items", "product_id", f"SELECT count(*) FROM {DEFECT_ITEMS} WHERE n % 79 = 0"),
        check_row("relationships", "raw_orders", "customer_id", "SELECT count(*) FROM raw_orders WHERE CAST(substr(order_id, 4) AS BIGINT) % 71 = 0"),
        check_row("rule", "competitor_prices", "empty product_name", "SELECT count(*) FROM raw_prices WHERE section LIKE 'SMALL%'"),
        check_row("rule", "competitor_prices", "price not positive", "SELECT count(*) FROM raw_prices WHERE section LIKE 'ECONOMY%'"),
        check_row("unique", "competitor_prices", "product_name, category",
                  "SELECT count(*) FROM (SELECT 1 FROM (SELECT CASE WHEN section LIKE 'SMALL%' THEN ' ' ELSE product_name END AS name, category FROM raw_prices) GROUP BY name, category HAVING count(*) > 1)"),
    ]),
    "scrape_validation": " UNION ALL ".join([
        check_row("rule", "competitor_prices", "empty product_name", "SELECT count(*) FROM raw_prices WHERE trim(product_name) = ''"),
        check_row("rule", "competitor_prices", "price not positive", "SELECT count(*) FROM raw_prices WHERE competitor_price <= 0"),
        check_row("unique", "competitor_prices", "product_name, category",
                  "SELECT count(*) FROM (SELECT 1 FROM raw_prices GROUP BY product_name, category HAVING count(*) > 1)"),
    ]),
    **_checks(),
    # Dashboards
    "dashboard_kpis": f"""SELECT CAST(round(sum(net_revenue), 0) AS DOUBLE) AS total_revenue, count(DISTINCT order_id) AS total_orders,
        count(DISTINCT customer_sk) AS active_customers, CAST({mean('margin_pct', 2)} AS DOUBLE) AS avg_margin_pct,
        CAST({ratio('sum(net_revenue)', 'count(DISTINCT order_id)')} AS DOUBLE) AS aov FROM fct_sales""",
    "kpi_cards": f"""SELECT '$' || format('{{:,.0f}}', CAST(round(sum(net_revenue), 0) AS DOUBLE)) AS total_revenue,
        format('{{:,}}', count(DISTINCT order_id)) AS total_orders, format('{{:,}}', count(DISTINCT customer_sk)) AS active_customers,
        format('{{:,.1f}}', CAST(round({mean('margin_pct', 2)}, 1) AS DOUBLE)) || '%' AS avg_margin,
        '$' || format('{{:,.2f}}', CAST({ratio('sum(net_revenue)', 'count(DISTINCT order_id)')} AS DOUBLE)) AS aov FROM fct_sales""",
    "dashboard_monthly": """SELECT strftime(m, '%b') AS month_name, CAST(month(m) AS INTEGER) AS month_num, m AS month_start,
        CAST(round(sum(net_revenue), 0) AS DOUBLE) AS monthly_revenue
        FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, net_revenue FROM fct_sales) GROUP BY m
        ORDER BY month_num, month_start LIMIT 12""",
    "top_categories_5": """SELECT category, CAST(round(sum(net_revenue), 0) AS DOUBLE) AS total_revenue FROM fct_sales
        JOIN dim_product USING (product_sk) GROUP BY category ORDER BY total_revenue DESC, category LIMIT 5""",
    "top_products_5": """SELECT product_name AS name, category, CAST(round(sum(net_revenue), 0) AS DOUBLE) AS revenue FROM fct_sales
        JOIN dim_product USING (product_sk) GROUP BY product_name, category ORDER BY revenue DESC, name, category LIMIT 5""",
    "daily_series": """SELECT order_date, CAST(round(net_revenue, 0) AS DOUBLE) AS net_revenue, CAST(round(gross_profit, 0) AS DOUBLE) AS gross_profit,
        num_orders, CAST(margin_pct AS DOUBLE) AS margin_pct FROM trends""",
    "monthly_revenue": f"""SELECT DISTINCT month_name, month, CAST(round(monthly_revenue, 0) AS DOUBLE) AS monthly_revenue, monthly_orders,
        {dbl('avg_margin_pct', 'mom_growth_pct')} FROM trends""",
    "monthly_table": f"""SELECT DISTINCT month_name, month, CAST(round(monthly_revenue, 0) AS DOUBLE) AS monthly_revenue, monthly_orders,
        {dbl('avg_margin_pct', 'mom_growth_pct')}, CASE WHEN mom_growth_pct IS NULL THEN '—' WHEN mom_growth_pct >= 0
        THEN concat('+', CAST(mom_growth_pct AS VARCHAR), '%') ELSE concat(CAST(mom_growth_pct AS VARCHAR), '%') END AS growth FROM trends""",
    "category_summary": f"SELECT category, units, {dbl('revenue', 'avg_margin')} FROM ({CATEGORY_SUMMARY})",
    "top_products_20": f"SELECT product_name, category, units_sold, {dbl('revenue', 'avg_margin', 'avg_price', 'competitor_price')} FROM ({TOP_20})",
    "competitor_scatter": f"""SELECT CAST(avg_price AS DOUBLE) AS our_price, CAST(competitor_price AS DOUBLE) AS competitor_price, category
        FROM ({TOP_20}) WHERE competitor_price <> 0""",
    "price_position": f"""SELECT product_name, category, CAST(avg_price - competitor_price AS DOUBLE) AS delta,
        CASE WHEN competitor_price IS NULL THEN 'N/A' WHEN avg_price < competitor_price THEN '▼ $' || format('{{:.2f}}', CAST(competitor_price - avg_price AS DOUBLE))
             ELSE '▲ $' || format('{{:.2f}}', CAST(avg_price - competitor_price AS DOUBLE)) END AS direction,
        CASE WHEN avg_margin >= 40 THEN 'high' WHEN avg_margin >= 25 THEN 'medium' ELSE 'low' END AS margin_band FROM ({TOP_20})""",
    "product_kpis": f"""SELECT (SELECT count(*) FROM dim_product) AS total_products,
        CAST((SELECT {mean('avg_margin', 1)} FROM ({CATEGORY_SUMMARY})) AS DOUBLE) AS avg_margin,
        (SELECT category FROM ({CATEGORY_SUMMARY}) ORDER BY revenue DESC, category LIMIT 1) AS top_category,
        (SELECT count(*) FROM ({TOP_20}) WHERE avg_price < competitor_price) AS price_advantage_count""",
    "top_customers": f"SELECT full_name, city, age_group, total_orders, {dbl('total_revenue', 'avg_order_value')}, segment FROM ({TOP_25})",
    "top_customers_by_key": """SELECT full_name, city, age_group, customer_sk, count(DISTINCT order_id) AS total_orders,
        CAST(round(sum(net_revenue), 0) AS DOUBLE) AS total_revenue FROM fct_sales JOIN dim_customer USING (customer_sk)
        GROUP BY full_name, city, age_group, customer_sk ORDER BY total_revenue DESC, full_name, city, age_group, customer_sk LIMIT 25""",
    "clv_segments": f"""SELECT CASE WHEN clv < 1000 THEN 'Standard (< $1k)' WHEN clv < 5000 THEN 'Mid Value ($1k–$5k)'
        WHEN clv < 15000 THEN 'High Value ($5k–$15k)' ELSE 'VIP (> $15k)' END AS segment, count(*) AS count FROM ({CUSTOMER_VALUE}) GROUP BY 1""",
    "age_group_revenue": f"""SELECT age_group, CAST(round(sum(net_revenue), 0) AS DOUBLE) AS total_revenue,
        CAST({mean('clv', 0)} AS DOUBLE) AS avg_clv
        FROM fct_sales JOIN dim_customer USING (customer_sk) JOIN ({CUSTOMER_VALUE}) USING (customer_sk) GROUP BY age_group""",
    "age_group_revenue_by_customer": f"""SELECT age_group, CAST(round(sum(clv), 0) AS DOUBLE) AS total_revenue, CAST({mean('clv', 0)} AS DOUBLE) AS avg_clv
        FROM dim_customer JOIN ({CUSTOMER_VALUE}) USING (customer_sk) GROUP BY age_group""",
    "payment_method_lines": "SELECT payment_method AS method, count(*) AS count FROM fct_sales GROUP BY payment_method",
    "registration_trend": """SELECT strftime(registration_date, '%b') AS month, CAST(month(registration_date) AS INTEGER) AS month_num,
        count(*) AS count FROM dim_customer GROUP BY 1, 2""",
    "customer_kpis": f"""SELECT (SELECT count(*) FROM dim_customer) AS total_customers, CAST({mean('total_revenue', 0)} AS DOUBLE) AS avg_clv,
        count(*) FILTER (WHERE segment = 'VIP') AS vip_count, CAST({mean('total_orders', 1)} AS DOUBLE) AS avg_orders_per_customer FROM ({TOP_25})""",
    "customer_kpis_all": f"""SELECT (SELECT count(*) FROM dim_customer) AS total_customers, CAST({mean('revenue', 0)} AS DOUBLE) AS avg_clv,
        count(*) FILTER (WHERE revenue > 15000) AS vip_count, CAST({mean('total_orders', 1)} AS DOUBLE) AS avg_orders_per_customer
        FROM (SELECT full_name, city, age_group, count(DISTINCT order_id) AS total_orders, sum(net_revenue) AS revenue
              FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY full_name, city, age_group)""",
    "customer_search": "SELECT customer_sk, customer_id, full_name, city, age_group FROM dim_customer WHERE lower(concat_ws(' ', full_name, city, age_group)) LIKE '%nation\\_1%' ESCAPE '\\'",
    "category_filter": "SELECT product_id, product_name, category FROM dim_product WHERE contains(category, 'ECON')",
    "paged_results": f"SELECT product_id, product_name, {dbl('retail_price')} FROM dim_product ORDER BY dim_product.retail_price DESC, product_id LIMIT 15 OFFSET 15",
    # Pivots
    "pivot_rows": f"""SELECT * EXCLUDE (unit_price, net_revenue, gross_profit, margin_pct, competitor_price_delta),
        {dbl('unit_price', 'net_revenue', 'gross_profit', 'margin_pct', 'competitor_price_delta')} FROM flat""",
    "pivot_revenue_category_month": f"{MONTH_TABLE.format('category')} GROUP BY category UNION ALL {MONTH_TABLE.format(chr(39) + 'Totals' + chr(39))}",
    "pivot_orders_age_payment": "SELECT age_group, payment_method, count(*) AS value FROM flat GROUP BY 1, 2",
    "pivot_margin_category": f"SELECT category, subcategory, CAST({mean('margin_pct', 6)} AS DOUBLE) AS value FROM flat GROUP BY 1, 2",
    "pivot_revenue_city_age": "SELECT city, age_group, CAST(sum(net_revenue) AS DOUBLE) AS value FROM flat GROUP BY 1, 2",
    "pivot_with_totals": cell_totals("category", "payment_method", "CAST(sum(net_revenue) AS DOUBLE)"),
    "pivot_average_totals": cell_totals("age_group", "order_quarter", f"CAST({mean('margin_pct', 6)} AS DOUBLE)"),
    "pivot_count_unique": cell_totals("country", "order_year", "count(DISTINCT city)"),
    "pivot_median": cell_totals("category", "order_quarter", "CAST(round(CAST(median(CAST(net_revenue AS DOUBLE)) AS DECIMAL(20,8)), 6) AS DOUBLE)"),
    "pivot_min": cell_totals("category", "order_status", "CAST(min(unit_price) AS DOUBLE)"),
    "pivot_max": cell_totals("category", "order_status", "CAST(max(unit_price) AS DOUBLE)"),
    "pivot_sum_over_sum": cell_totals("category", "order_status", f"CAST({ratio('sum(gross_profit)', 'sum(net_revenue)', 6)} AS DOUBLE)"),
    "pivot_sample_stdev": cell_totals("category", "order_status", "CAST(round(CAST(stddev_samp(CAST(net_revenue AS DOUBLE)) AS DECIMAL(20,8)), 3) AS DOUBLE)"),
    "pivot_sample_variance": cell_totals("category", "order_status", "CAST(round(CAST(var_samp(CAST(quantity AS DOUBLE)) AS DECIMAL(20,8)), 6) AS DOUBLE)"),
    "pivot_list_unique": "SELECT age_group, order_status, array_to_string(list_sort(list(DISTINCT country)), ', ') AS value FROM flat GROUP BY 1, 2",
    "pivot_first_last": """SELECT category, order_status, arg_min(order_item_id, order_item_id) AS first_value, arg_max(order_item_id, order_item_id) AS last_value
        FROM fct_sales JOIN dim_product USING (product_sk) GROUP BY 1, 2""",
    "pivot_share_of_total": f"""SELECT category, payment_method, CAST({ratio('sum(net_revenue)', 'sum(sum(net_revenue)) OVER ()', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "pivot_share_of_row": f"""SELECT category, payment_method, CAST({ratio('sum(net_revenue)', 'sum(sum(net_revenue)) OVER (PARTITION BY category)', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "pivot_share_of_column": f"""SELECT category, payment_method, CAST({ratio('sum(net_revenue)', 'sum(sum(net_revenue)) OVER (PARTITION BY payment_method)', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "pivot_count_share_of_total": f"""SELECT category, payment_method, CAST({ratio('count(*)', 'sum(count(*)) OVER ()', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "pivot_count_share_of_row": f"""SELECT category, payment_method, CAST({ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY category)', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "pivot_count_share_of_column": f"""SELECT category, payment_method, CAST({ratio('count(*)', 'sum(count(*)) OVER (PARTITION BY payment_method)', 6)} AS DOUBLE) AS value
        FROM flat GROUP BY 1, 2""",
    "unique_values": "SELECT DISTINCT category, country AS value FROM flat WHERE country IS NOT NULL",
    "records_all": "SELECT order_id, customer_id, order_date, order_status, payment_method FROM stg_orders",
    "records_round_trip": "SELECT order_id, order_date, order_status FROM stg_orders",
    "pivot_two_columns": " UNION ALL ".join(
        f"""SELECT {y} AS order_year, {h} AS heading, CAST(sum(net_revenue) AS DOUBLE) AS value
        FROM (SELECT CAST(order_year AS VARCHAR) AS y, coalesce(CASE WHEN age_group <> '65+' THEN age_group END, '\\N') || ' / ' || order_status AS h, net_revenue FROM flat)
        GROUP BY ALL""" for y, h in (("y", "h"), ("y", "'Totals'"), ("'Totals'", "h"), ("'Totals'", "'Totals'"))
    ),
    # Questions
    "ask_top_customers": """SELECT full_name, city, age_group, count(DISTINCT order_id) AS total_orders, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue
        FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY full_name, city, age_group
        ORDER BY sum(net_revenue) DESC, full_name, city, age_group LIMIT 10""",
    "top_customers_5": """SELECT full_name, city, age_group, count(DISTINCT order_id) AS total_orders, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue
        FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY full_name, city, age_group
        ORDER BY sum(net_revenue) DESC, full_name, city, age_group LIMIT 5""",
    "ask_monthly_trend": f"SELECT month_name, month, {dbl('monthly_revenue')}, num_orders, {dbl('mom_growth_pct')} FROM trends",
    "ask_category_performance": """SELECT category, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(round(avg_margin_pct, 1) AS DOUBLE) AS avg_margin_pct,
        num_orders FROM categories ORDER BY revenue_rank, category, subcategory LIMIT 10""",
    "ask_competitor_prices": f"""SELECT product_name, category, {dbl('retail_price')}, CAST(avg_competitor_price AS DOUBLE) AS competitor_price,
        {dbl('price_vs_competitor')} FROM dim_product WHERE avg_competitor_price IS NOT NULL ORDER BY dim_product.retail_price DESC, product_sk LIMIT 20""",
    "ask_default_monthly": """SELECT strftime(order_date, '%b') AS month_name, CAST(round(sum(net_revenue), 2) AS DOUBLE) AS total_revenue,
        count(DISTINCT order_id) AS total_orders FROM fct_sales GROUP BY 1""",
    "highest_margin_categories": f"""SELECT category, CAST(sum(net_revenue) AS DOUBLE) AS revenue, CAST(sum(gross_profit) AS DOUBLE) AS profit,
        CAST({ratio('sum(gross_profit)', 'sum(net_revenue)', 2, 100)} AS DOUBLE) AS margin_pct FROM fct_sales JOIN dim_product USING (product_sk) GROUP BY category""",
    "highest_margin_products": f"""SELECT product_id, product_name, category, CAST(sum(net_revenue) AS DOUBLE) AS revenue, CAST(sum(gross_profit) AS DOUBLE) AS profit,
        CAST({ratio('sum(gross_profit)', 'sum(net_revenue)', 2, 100)} AS DOUBLE) AS margin_pct FROM fct_sales JOIN dim_product USING (product_sk)
        WHERE category = 'ECONOMY' GROUP BY 1, 2, 3 ORDER BY margin_pct DESC, product_id LIMIT 10""",
    "revenue_by_region": """SELECT region, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
        count(DISTINCT customer_sk) AS num_customers FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY region""",
    "revenue_by_age_group": """SELECT age_group, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue, CAST(sum(gross_profit) AS DOUBLE) AS total_profit,
        count(DISTINCT customer_sk) AS num_customers FROM fct_sales JOIN dim_customer USING (customer_sk) GROUP BY age_group""",
    "lapsed_customers": f"""SELECT c.customer_id, c.full_name, c.email, l.last_order_date,
        date_diff('day', l.last_order_date, {AS_OF}) AS days_since_last_order, CAST(clv.total_revenue AS DOUBLE) AS total_revenue
        FROM dim_customer c LEFT JOIN (SELECT customer_id, max(order_date) AS last_order_date FROM stg_orders GROUP BY customer_id) l
        ON l.customer_id = c.customer_id LEFT JOIN clv ON clv.customer_id = c.customer_id
        WHERE l.last_order_date IS NULL OR date_diff('day', l.last_order_date, {AS_OF}) >= 90""",
    "lapsed_customers_revenue": f"""SELECT customer_id, full_name, email, last_order_date, days_since_last_order, {dbl('total_revenue')}
        FROM clv WHERE days_since_last_order >= 180""",
    "aov_by_payment_method": f"""SELECT payment_method, count(DISTINCT order_id) AS num_orders, CAST(sum(net_revenue) AS DOUBLE) AS revenue,
        CAST({ratio('sum(net_revenue)', 'count(DISTINCT order_id)')} AS DOUBLE) AS aov FROM fct_sales GROUP BY payment_method""",
    "priced_above_competitor": f"""SELECT product_id, product_name, category, {dbl('retail_price', 'avg_competitor_price', 'price_vs_competitor')}
        FROM dim_product WHERE price_vs_competitor > 0""",
    "monthly_trend_year": f"""SELECT year, month, month_name, {dbl('monthly_revenue', 'monthly_profit')}, monthly_orders, {dbl('mom_growth_pct')}
        FROM monthly WHERE year = 1996""",
    "last_6_months": f"""SELECT strftime(order_date, '%Y-%m') AS year_month, CAST(sum(net_revenue) AS DOUBLE) AS total_revenue,
        count(DISTINCT order_id) AS num_orders FROM fct_sales
        WHERE is_revenue_order AND order_date > {AS_OF} - INTERVAL 6 MONTH AND order_date <= {AS_OF} GROUP BY 1""",
    "guarded_sql_ok": """SELECT region, count(DISTINCT customer_sk) AS customers, count(*) AS lines FROM fct_sales JOIN dim_customer USING (customer_sk)
        GROUP BY region""",
    "guarded_sql_truncated": """SELECT order_item_id, quantity, (SELECT count(*) FROM fct_sales) > 500 AS truncated FROM fct_sales ORDER BY order_item_id LIMIT 500""",
}


def oracle_statements() -> dict[str, str]:
    return {name: with_tables(select) for name, select in STATEMENTS.items()}

"""DuckDB definitions of the raw tables, staging tables, marts and analytics."""

from __future__ import annotations

import re

AS_OF = "DATE '2001-12-31'"


def ratio(numerator: str, denominator: str, scale: int = 2, times: int = 1) -> str:
    scaled = f"CAST({numerator} AS DOUBLE) / NULLIF(CAST({denominator} AS DOUBLE), 0)"
    if times != 1:
        scaled = f"({scaled}) * {times}"
    return f"ROUND(CAST({scaled} AS DECIMAL(20,8)), {scale})"


def mean(value: str, scale: int) -> str:
    return ratio(f"SUM({value})", f"COUNT({value})", scale)


def dbl(*names: str) -> str:
    """Columns cast to double under their own names."""
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


def pick(number: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {cases} END"


COUNTRIES = ["United States", "Canada", "United Kingdom", "Germany", "France", "Australia", "Japan", "Singapore", "India", "UAE", "Brazil"]
AGES = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
STATUSES = ["Processing", "Cancelled", "Returned"]

MARGIN = ratio("retail_price - base_cost", "retail_price", 2, 100)
NET = "net_revenue"

TABLES = {
    "raw_customers": f"""
        SELECT concat('CUST', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS customer_id,
               concat(' ', c_name, ' ') AS full_name,
               CASE WHEN c_custkey % 25 = 0 THEN 'Non-binary ' WHEN c_custkey % 25 = 1 THEN ' female'
                    WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
               concat(lower(replace(c_name, '#', '.')), '@Example.COM') AS email,
               n_name AS city, {pick('c_nationkey', COUNTRIES)} AS country,
               DATE '1994-01-01' + CAST((c_custkey * 37) % 2900 AS INTEGER) AS registration_date,
               {pick('c_custkey', AGES)} AS age_group
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "numbered_products": """
        SELECT p_partkey AS product_no, p_size AS size,
               concat('PROD', lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS product_id,
               p_type AS category, p_brand AS subcategory,
               concat(p_name, ' ', CAST(p_partkey % 40 AS VARCHAR)) AS product_name,
               CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(CASE p_partkey % 4 WHEN 0 THEN 0.04 WHEN 1 THEN 0.15
                    WHEN 2 THEN 0.40 ELSE 1.00 END AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS retail_price,
               concat('Supplier ', CAST(p_partkey % 10 AS VARCHAR)) AS supplier_name
        FROM part""",
    "raw_products": """
        SELECT product_id, category, subcategory, product_name, retail_price,
               CAST(retail_price * CAST(CASE WHEN product_no % 50 = 0 THEN 1.20 ELSE 0.60 END AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS base_cost,
               supplier_name
        FROM numbered_products""",
    "raw_orders": f"""
        SELECT concat('ORD', CAST(o_orderkey AS VARCHAR)) AS order_id,
               concat('CUST', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS customer_id,
               CAST(o_orderdate AS DATE) AS order_date, concat(o_orderpriority, ' ') AS payment_method,
               CASE WHEN o_orderstatus = 'F' THEN 'Completed'
                    WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 10 = 0 THEN ' Shipped' ELSE 'Shipped' END
                    ELSE {pick('o_orderkey', STATUSES)} END AS order_status
        FROM orders""",
    "raw_items": """
        SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                         CAST(l_linenumber AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS order_item_id,
               concat('ORD', CAST(l_orderkey AS VARCHAR)) AS order_id,
               concat('PROD', lpad(CAST(l_partkey AS VARCHAR), 8, '0')) AS product_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(12,0))
                    * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS unit_price,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_discount AS DECIMAL(5,4)) END AS discount
        FROM lineitem""",
    "raw_prices": """
        SELECT concat(' ', lower(product_name), CASE WHEN size > 17 THEN ' v2' ELSE '' END, ' ') AS product_name, subcategory AS category, category AS section,
               CAST(retail_price * CAST(0.95 AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS competitor_price
        FROM numbered_products""",
    "stg_customers": f"""
        SELECT customer_id, trim(full_name) AS full_name, upper(trim(gender)) AS gender, lower(trim(email)) AS email,
               trim(city) AS city, trim(country) AS country, registration_date,
               CAST(year(registration_date) AS INTEGER) AS registration_year, trim(age_group) AS age_group,
               CAST(date_diff('day', registration_date, {AS_OF}) AS INTEGER) AS tenure_days
        FROM raw_customers
        WHERE customer_id IS NOT NULL AND email IS NOT NULL AND registration_date IS NOT NULL""",
    "stg_products": f"""
        SELECT product_id, trim(category) AS category, trim(subcategory) AS subcategory, trim(product_name) AS product_name,
               retail_price, base_cost, trim(supplier_name) AS supplier_name,
               CASE WHEN retail_price > 0 THEN {MARGIN} ELSE 0 END AS gross_margin_pct,
               CASE WHEN retail_price < 50 THEN 'Budget' WHEN retail_price < 200 THEN 'Mid-range'
                    WHEN retail_price < 500 THEN 'Premium' ELSE 'Luxury' END AS price_tier
        FROM raw_products WHERE product_id IS NOT NULL AND retail_price > 0 AND base_cost > 0""",
    "stg_orders": """
        SELECT order_id, customer_id, order_date, trim(payment_method) AS payment_method, trim(order_status) AS order_status,
               coalesce(order_status IN ('Completed', 'Shipped'), FALSE) AS is_revenue_order,
               CAST(year(order_date) AS INTEGER) AS order_year, CAST(month(order_date) AS INTEGER) AS order_month,
               CAST(quarter(order_date) AS INTEGER) AS order_quarter
        FROM raw_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL""",
    "stg_items": """
        SELECT order_item_id, order_id, product_id, quantity, unit_price,
               CAST(greatest(0, least(1, coalesce(discount, 0))) AS DECIMAL(5,4)) AS discount,
               CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS gross_revenue,
               CAST(round(quantity * unit_price * (1 - coalesce(discount, 0)), 2) AS DECIMAL(18,2)) AS net_revenue
        FROM raw_items
        WHERE order_item_id IS NOT NULL AND order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND unit_price > 0""",
    "dim_customer": """
        SELECT row_number() OVER (ORDER BY customer_id) AS customer_sk, *,
               CASE WHEN tenure_days > 365 THEN 'Loyal' WHEN tenure_days > 90 THEN 'Regular' ELSE 'New' END AS customer_segment,
               CASE WHEN country IN ('United States', 'Canada') THEN 'North America'
                    WHEN country IN ('United Kingdom', 'Germany', 'France') THEN 'Europe'
                    WHEN country IN ('Australia', 'Japan', 'Singapore', 'India') THEN 'APAC'
                    WHEN country = 'UAE' THEN 'Middle East' ELSE 'Other' END AS region
        FROM stg_customers""",
    "dim_product": f"""
        SELECT row_number() OVER (ORDER BY product_id) AS product_sk, s.*, avg_competitor_price,
               round(retail_price - avg_competitor_price, 2) AS price_vs_competitor
        FROM stg_products s
        LEFT JOIN (SELECT upper(trim(product_name)) AS name, {mean('competitor_price', 6)} AS avg_competitor_price
                   FROM raw_prices GROUP BY 1) c ON upper(trim(s.product_name)) = c.name""",
    "fct_sales": f"""
        SELECT md5(order_item_id) AS sale_sk, order_item_id, order_id,
               CAST(strftime(order_date, '%Y%m%d') AS INTEGER) AS order_date_sk, order_date, customer_sk, product_sk,
               payment_method, order_status, is_revenue_order, quantity, unit_price, discount, gross_revenue, net_revenue,
               CAST(round(quantity * base_cost, 2) AS DECIMAL(18,2)) AS cogs,
               CAST(round(net_revenue - quantity * base_cost, 2) AS DECIMAL(18,2)) AS gross_profit,
               CASE WHEN net_revenue > 0 THEN {ratio('net_revenue - quantity * base_cost', 'net_revenue', 2, 100)} ELSE 0 END AS margin_pct,
               avg_competitor_price AS competitor_price, round(unit_price - avg_competitor_price, 2) AS price_delta
        FROM stg_items JOIN stg_orders USING (order_id)
        JOIN dim_customer USING (customer_id) JOIN dim_product USING (product_id)""",
    "daily": f"""
        SELECT order_date, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
               strftime(order_date, '%b') AS month_name, CAST(quarter(order_date) AS INTEGER) AS quarter,
               count(DISTINCT order_id) AS num_orders, count(order_item_id) AS num_items,
               sum(net_revenue) AS net_revenue, sum(gross_revenue) AS gross_revenue, sum(gross_profit) AS gross_profit,
               {ratio('sum(gross_profit)', 'sum(net_revenue)', 2, 100)} AS margin_pct,
               sum(sum(net_revenue)) OVER (PARTITION BY year(order_date) ORDER BY order_date
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd_revenue
        FROM fct_sales WHERE is_revenue_order GROUP BY order_date""",
    "months": f"""
        SELECT year, month, month_name, quarter, sum(net_revenue) AS monthly_revenue, sum(gross_profit) AS monthly_profit,
               CAST(sum(num_orders) AS BIGINT) AS monthly_orders, {mean('margin_pct', 2)} AS avg_margin_pct,
               lag(sum(net_revenue)) OVER (ORDER BY year, month) AS prev_month_revenue
        FROM daily GROUP BY year, month, month_name, quarter""",
    "monthly": f"""
        SELECT *, {ratio('monthly_revenue - prev_month_revenue', 'prev_month_revenue', 2, 100)} AS mom_growth_pct FROM months""",
    "trends": """
        SELECT d.order_date, d.year, d.month, d.month_name, d.quarter, num_orders, num_items, net_revenue, gross_revenue,
               gross_profit, margin_pct, ytd_revenue, monthly_revenue, monthly_profit, monthly_orders, avg_margin_pct,
               prev_month_revenue, mom_growth_pct
        FROM daily d JOIN monthly m ON d.year = m.year AND d.month = m.month""",
    "categories": f"""
        SELECT category, subcategory, count(DISTINCT product_sk) AS num_products, count(DISTINCT order_id) AS num_orders,
               count(order_item_id) AS num_items_sold, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
               sum(net_revenue) AS total_revenue, sum(gross_profit) AS total_profit,
               {mean('margin_pct', 2)} AS avg_margin_pct, {mean('unit_price', 2)} AS avg_selling_price,
               {ratio('sum(net_revenue)', 'count(DISTINCT order_id)')} AS revenue_per_order,
               CAST(rank() OVER (ORDER BY sum(net_revenue) DESC) AS INTEGER) AS revenue_rank,
               CAST(rank() OVER (ORDER BY sum(gross_profit) DESC) AS INTEGER) AS profit_rank,
               {ratio('sum(net_revenue)', 'sum(sum(net_revenue)) OVER ()', 2, 100)} AS revenue_share_pct
        FROM fct_sales JOIN dim_product USING (product_sk) WHERE is_revenue_order GROUP BY category, subcategory""",
    "customer_totals": f"""
        SELECT customer_sk, count(DISTINCT order_id) AS total_orders, count(order_item_id) AS total_items,
               sum(net_revenue) AS total_revenue, sum(gross_profit) AS total_profit,
               min(order_date) AS first_order_date, max(order_date) AS last_order_date,
               CAST(date_diff('day', min(order_date), max(order_date)) AS INTEGER) AS active_days,
               CAST(date_diff('day', max(order_date), {AS_OF}) AS INTEGER) AS days_since_last_order,
               {mean('net_revenue', 2)} AS avg_item_value
        FROM fct_sales WHERE is_revenue_order GROUP BY customer_sk""",
    "rfm": """
        SELECT *, CAST(ntile(5) OVER (ORDER BY days_since_last_order, customer_sk) AS INTEGER) AS recency_score,
               CAST(ntile(5) OVER (ORDER BY total_orders DESC, customer_sk) AS INTEGER) AS frequency_score,
               CAST(ntile(5) OVER (ORDER BY total_revenue DESC, customer_sk) AS INTEGER) AS monetary_score
        FROM customer_totals""",
    "rfm_high": """
        SELECT *, CAST(ntile(5) OVER (ORDER BY days_since_last_order DESC, customer_sk) AS INTEGER) AS recency_score,
               CAST(ntile(5) OVER (ORDER BY total_orders, customer_sk) AS INTEGER) AS frequency_score,
               CAST(ntile(5) OVER (ORDER BY total_revenue, customer_sk) AS INTEGER) AS monetary_score
        FROM customer_totals""",
    "clv": """
        SELECT c.customer_sk, customer_id, full_name, email, city, country, region, age_group, customer_segment,
               r.* EXCLUDE (customer_sk), recency_score + frequency_score + monetary_score AS rfm_total,
               CASE WHEN recency_score + frequency_score + monetary_score >= 13 THEN 'Champions'
                    WHEN recency_score + frequency_score + monetary_score >= 10 THEN 'Loyal'
                    WHEN recency_score + frequency_score + monetary_score >= 7 THEN 'Potential Loyal'
                    WHEN recency_score >= 4 THEN 'Recent'
                    WHEN frequency_score >= 4 OR monetary_score >= 4 THEN 'At Risk' ELSE 'Hibernating' END AS clv_tier
        FROM rfm r JOIN dim_customer c USING (customer_sk)""",
    "spine": """
        SELECT CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT min(order_date) AS first_day, max(order_date) AS last_day FROM stg_orders)""",
    "flat": """
        SELECT category, subcategory, supplier_name, age_group, city, country, payment_method, order_status,
               strftime(order_date, '%b') AS order_month, concat('Q', CAST(quarter(order_date) AS VARCHAR)) AS order_quarter,
               CAST(year(order_date) AS VARCHAR) AS order_year, quantity, unit_price, net_revenue, gross_profit,
               round(margin_pct, 1) AS margin_pct, price_delta AS competitor_price_delta
        FROM fct_sales JOIN dim_product USING (product_sk) JOIN dim_customer USING (customer_sk)""",
}


def with_tables(select: str) -> str:
    """Prefix a statement with the definitions it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(select)
    if not needed:
        return select
    parts = ", ".join(f"{name} AS MATERIALIZED ({TABLES[name]})" for name in TABLES if name in needed)
    return f"WITH {parts} {select}"

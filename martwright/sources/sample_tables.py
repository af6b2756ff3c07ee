"""The five raw retail tables derived from order-management parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.sources.schemas import RawTables
from martwright.sources.tables import spread

# Labels by key remainder.
COUNTRIES = ["United States", "Canada", "United Kingdom", "Germany", "France", "Australia", "Japan", "Singapore", "India", "UAE", "Brazil"]
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
OPEN_STATUSES = ["Processing", "Cancelled", "Returned"]
PRICE_FACTORS = ["0.04", "0.15", "0.40", "1.00"]
COMPETITOR_SOURCE = "Other Store"
# The competitor lists parts up to this size under the same name, larger ones under another.
SAME_NAME_SIZE = 17


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(number: Column, values: list[str]) -> Column:
    return F.element_at(F.lit(values), ((number % len(values)) + 1).cast("int"))


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(4,2)")


def customer_key(number: Column) -> Column:
    return F.concat(F.lit("CUST"), F.lpad(number.cast("string"), 9, "0"))


def product_key(number: Column) -> Column:
    return F.concat(F.lit("PROD"), F.lpad(number.cast("string"), 8, "0"))


def order_key(number: Column) -> Column:
    return F.concat(F.lit("ORD"), number.cast("string"))


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    remainder = key % 25
    gender = F.when(remainder == 0, "Non-binary ").when(remainder == 1, " female").when(key % 2 == 0, "Male").otherwise("Female")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        customer_key(key).alias("customer_id"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("full_name"),
        gender.alias("gender"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Example.COM")).alias("email"),
        F.col("n_name").alias("city"),
        _pick(F.col("c_nationkey"), COUNTRIES).alias("country"),
        F.date_add(F.lit("1994-01-01").cast("date"), ((key * 37) % 2900).cast("int")).alias("registration_date"),
        _pick(key, AGE_GROUPS).alias("age_group"),
    )


def numbered_products(part: DataFrame) -> DataFrame:
    """Products with the part number and size they come from."""
    key = F.col("p_partkey")
    factor = F.element_at(F.array(*[_decimal(f) for f in PRICE_FACTORS]), ((key % len(PRICE_FACTORS)) + 1).cast("int"))
    retail = (F.col("p_retailprice").cast("decimal(10,2)") * factor).cast("decimal(10,2)")
    cost_factor = F.when(key % 50 == 0, _decimal("1.20")).otherwise(_decimal("0.60"))
    return part.select(
        key.alias("product_no"),
        F.col("p_size").alias("size"),
        product_key(key).alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.concat("p_name", F.lit(" "), (key % 40).cast("string")).alias("product_name"),
        retail.alias("retail_price"),
        (retail * cost_factor).cast("decimal(10,2)").alias("base_cost"),
        F.concat(F.lit("Supplier "), (key % 10).cast("string")).alias("supplier_name"),
    )


def products(part: DataFrame) -> DataFrame:
    return numbered_products(part).drop("product_no", "size")


def orders(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    shipped = F.when(key % 10 == 0, " Shipped").otherwise("Shipped")
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", shipped)
    return orders.select(
        order_key(key).alias("order_id"),
        customer_key(F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.concat("o_orderpriority", F.lit(" ")).alias("payment_method"),
        status.otherwise(_pick(key, OPEN_STATUSES)).alias("order_status"),
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    each = F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)")
    return lineitem.select(
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("order_item_id"),
        order_key(F.col("l_orderkey")).alias("order_id"),
        product_key(F.col("l_partkey")).alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (each.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(10,2)").alias("unit_price"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount").cast("decimal(5,4)")).alias("discount"),
    )


def competitor_prices(part: DataFrame) -> DataFrame:
    other = F.when(F.col("size") > SAME_NAME_SIZE, " v2").otherwise("")
    return numbered_products(part).select(
        F.concat(F.lit(" "), F.lower("product_name"), other, F.lit(" ")).alias("product_name"),
        F.col("subcategory").alias("category"),
        F.col("category").alias("section"),
        (F.col("retail_price") * _decimal("0.95")).cast("decimal(10,2)").alias("competitor_price"),
        F.lit("In Stock").alias("stock_status"),
        F.lit(None).cast("timestamp_ntz").alias("scraped_at"),
        F.lit(COMPETITOR_SOURCE).alias("source"),
    )


def raw_tables(spark: SparkSession, folder: str) -> RawTables:
    part = table(spark, folder, "part")
    return RawTables(
        customers=customers(table(spark, folder, "customer"), table(spark, folder, "nation")),
        products=products(part),
        orders=orders(spread(table(spark, folder, "orders"), "o_orderkey")),
        order_items=order_items(spread(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")),
        competitor_prices=competitor_prices(part),
    )

"""The star schema and its pre-aggregates as written tables."""

from __future__ import annotations

import datetime as dt
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.operators.joins import hot_values
from martwright.plans import analytics, marts, staging
from martwright.session import shared_folder
from martwright.sources.schemas import RawTables
from martwright.sources.tables import collect_garbage, curve, curve_clustered, remove_folder


class Warehouse:
    """Staging frames are lazy; marts and analytics are written on first use.

    Every report reads the fact several times over its life, so it is stored once in
    the shared folder, arranged along a curve over date and product, instead of being rebuilt.
    """

    def __init__(self, spark: SparkSession, raw: RawTables, as_of: dt.date, folder: str | None = None,
                 trim_first: bool = False, clamp_revenue: bool = False, orientation: str = "reference",
                 built_at: dt.datetime | None = None):
        self.spark = spark
        self.raw = raw
        self.as_of = as_of
        self.folder = f"{folder or shared_folder(spark)}/warehouse-{uuid.uuid4().hex[:12]}"
        self.orientation = orientation
        self.built_at = F.lit(built_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        self.stg_customers = staging.stg_customers(raw.customers, as_of)
        self.stg_products = staging.stg_products(raw.products)
        self.stg_orders = staging.stg_orders(raw.orders, trim_first)
        self.stg_order_items = staging.stg_order_items(raw.order_items, clamp_revenue)
        # Raw rows next to what is staged of them.
        rows = {
            "customers": staging.customer_rows(as_of), "products": staging.product_rows(),
            "orders": staging.order_rows(trim_first), "order_items": staging.item_rows(clamp_revenue),
        }
        self.beside_raw = {name: staging.beside_raw(getattr(raw, name), row) for name, row in rows.items()}

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        collect_garbage(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return marts.dim_customer(self.stg_customers, self.folder).withColumn("updated_at", self.built_at)

    @cached_property
    def dim_product(self) -> DataFrame:
        numbered = marts.dim_product(self.stg_products, self.raw.competitor_prices, self.folder)
        return numbered.withColumn("updated_at", self.built_at)

    @cached_property
    def dim_date(self) -> DataFrame:
        """Every day from the first to the last order."""
        span = self.stg_orders.agg(F.min("order_date").alias("start"), F.max("order_date").alias("end"))
        return self._stored(marts.date_attributes(marts.spine_between(span, "start", "end"), self.as_of), "dim_date")

    def sale_lines(self) -> DataFrame:
        """What the fact is derived from, as a lazy plan over the staging frames and dimensions."""
        return marts.sale_lines(
            self.stg_order_items, self.stg_orders, self.dim_customer, self.dim_product, self.raw.order_items, self.raw.orders
        )

    def sales(self) -> DataFrame:
        """The fact as a lazy plan."""
        return marts.fact_rows(self.sale_lines())

    @cached_property
    def fct_sales(self) -> DataFrame:
        """Keys and measures are derived after the last shuffle, so that none of them goes through one."""
        lines = curve_clustered(self.sale_lines(), self.fact_curve)
        rows = marts.fact_rows(lines).withColumn("loaded_at", self.built_at)
        return marts.from_stored(self._stored(rows.drop("sale_sk", *marts.derived()), "fct_sales"), rows.columns)

    @cached_property
    def fact_curve(self) -> Column:
        """Place of a fact row on the curve over date and product."""
        days = self.dim_date.agg(F.min("date_actual"), F.max("date_actual")).first()
        products = self.dim_product.agg(F.min("product_sk"), F.max("product_sk")).first()
        first_day = F.lit(days[0]).cast("date")
        date = (F.datediff("order_date", first_day), F.lit(0), F.datediff(F.lit(days[1]).cast("date"), first_day))
        return curve(date, (F.col("product_sk"), *(F.lit(p).cast("long") for p in products)))

    @cached_property
    def _hot(self) -> dict[str, list]:
        return hot_values(self.fct_sales, ["product_sk", "customer_sk"])

    @property
    def hot_products(self) -> list:
        return self._hot["product_sk"]

    @property
    def hot_customers(self) -> list:
        return self._hot["customer_sk"]

    @cached_property
    def daily_revenue_trends(self) -> DataFrame:
        return self._stored(analytics.daily_revenue_trends(self.fct_sales), "daily_revenue_trends")

    @cached_property
    def top_product_categories(self) -> DataFrame:
        lazy = analytics.top_product_categories(self.fct_sales, self.dim_product, self.hot_products)
        return self._stored(lazy, "top_product_categories")

    @cached_property
    def customer_lifetime_value(self) -> DataFrame:
        lazy = analytics.customer_lifetime_value(self.fct_sales, self.dim_customer, self.as_of, self.orientation, self.folder)
        return self._stored(lazy, "customer_lifetime_value")

    def close(self) -> None:
        """Remove everything this warehouse has written; its frames can not be read any more."""
        remove_folder(self.spark, self.folder)

    def build(self, threads: int = 4) -> dict[str, DataFrame]:
        """All eleven models, stored where they are tables.

        Models that do not depend on each other are submitted together, so that the
        tail of one leaves no core idle.
        """
        steps = [
            ["stg_customers", "stg_products", "stg_orders", "stg_order_items"],
            ["dim_customer", "dim_product", "dim_date"],
            ["fct_sales"],
            ["daily_revenue_trends", "top_product_categories", "customer_lifetime_value"],
        ]
        with ThreadPoolExecutor(threads) as pool:
            return {name: df for step in steps for name, df in zip(step, pool.map(partial(getattr, self), step))}

"""Price-list pages for the check of the table extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def render_price_pages(products: DataFrame, rows_per_page: int = 200) -> DataFrame:
    """Price-list pages, each with the products of one category and id block.

    Pages hold a bounded number of rows, whatever the
    size of a category. Expects ``product_no`` besides the product columns.
    """
    def escaped(column: str) -> Column:
        return F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    price = F.concat(F.lit("$"), F.format_number(F.col("retail_price"), 2))
    row = F.concat(
        F.lit("<tr><td>"), escaped("product_name"), F.lit("</td><td>"), escaped("subcategory"),
        F.lit('</td><td class="price">'), price, F.lit("</td><td>In Stock</td></tr>"),
    )
    block = F.floor(F.col("product_no") / rows_per_page)
    pages = products.groupBy("category", block.alias("block")).agg(F.concat_ws("\n", F.collect_list(row)).alias("rows"))
    head = F.lit("<thead><tr><th>Name</th><th>Type</th><th>Price</th><th>Stock</th></tr></thead><tbody>")
    return pages.select(
        F.concat_ws("/", F.lit("prices"), "category", F.col("block").cast("string")).alias("url"),
        F.concat(
            F.lit("<html><body><h1>Prices</h1><h2>"), F.col("category"), F.lit('</h2>\n<table class="list">'),
            head, F.col("rows"), F.lit("</tbody></table></body></html>"),
        ).alias("html"),
    )

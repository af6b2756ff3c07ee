"""Product tables out of HTML pages."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from martwright.functions.arrays import LAST_SEEN, running
from martwright.functions.text import parse_price

# Case-insensitive, dot matches line ends.
_COMMENT = r"(?is)<!--.*?-->"
# Headings and tables in the order of the page.
_PART = r"(?is)<h2(?:\s[^>]*)?>.*?</h2>|<table(?:\s[^>]*)?>.*?</table>"
_BODY = r"(?is)<tbody(?:\s[^>]*)?>(.*?)(?:</tbody>|\z)"
# End tags of rows and cells may be left out.
_ROW = r"(?is)<tr(?:\s[^>]*)?>(.*?)(?=<tr[\s>]|</tr>|</tbody>|</table>|\z)"
_CELL = r"(?is)<td(?:\s[^>]*)?>(.*?)(?=<t[dhr][\s>]|</t[dr]>|</tbody>|</table>|\z)"
_TAG = r"(?s)<[^>]*>"

CELLS = ["section", "product_name", "category", "price_text", "stock_status"]


@F.pandas_udf(StructType([StructField(c, StringType()) for c in CELLS]))
def _plain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Decode entities and strip white space in a batch of cells."""
    for cells in batches:
        yield pd.DataFrame({c: s.map(lambda t: None if t is None else html.unescape(t).strip()) for c, s in zip(CELLS, cells)})


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def extract_html_tables(pages: DataFrame, html_col: str = "html", source: Column | None = None, scraped_at: Column | None = None) -> DataFrame:
    """Rows of every ``<h2>`` heading's following table, one output row each.

    A heading takes the next table after it; of equal headings on a page the last
    one counts. Rows with fewer than three cells are skipped and a missing fourth
    cell reads ``Unknown``. The page columns other than the text are kept. A page is
    looked through in its own row, in time that grows with its parts.
    """
    kept = [c for c in pages.columns if c != html_col]
    clean = F.regexp_replace(F.col(html_col), _COMMENT, "")
    found = pages.where(F.col(html_col).rlike("(?i)<h2") & F.col(html_col).rlike("(?i)<table"))
    found = found.select(*kept, _all(clean, _PART, 0).alias("_parts")).where(F.size("_parts") > 0)
    # From the last part backwards: place of the table seen last, before each part.
    tables = "transform(sequence(size(_parts) - 1, 0, -1), i -> CASE WHEN rlike(get(_parts, i), '(?i)^<table') THEN i ELSE -1 END)"
    found = found.withColumn("_tables", F.expr(tables))
    found = found.withColumn("_next", F.expr(running("_tables", LAST_SEEN, "-1")))
    # By title, the last of equal ones first.
    title = f"trim(regexp_replace(get(_parts, size(_parts) - 1 - i), r'{_TAG}', ''))"
    places = "filter(sequence(0, size(_parts) - 1), i -> get(_tables, i) < 0 AND get(_next, i) >= 0)"
    found = found.withColumn("_heads", F.expr(f"array_sort(transform({places}, i -> named_struct('title', {title}, 'back', i, 'table', get(_next, i))))"))
    last = "filter(_heads, (h, i) -> i = 0 OR get(_heads, i - 1).title <> h.title)"
    listed = F.expr(f"transform({last}, h -> named_struct('_titles', h.title, '_tables', get(_parts, h.table)))")
    sections = found.select(*kept, F.explode(listed).alias("_section"))
    table = F.col("_section._tables")
    body = F.when(table.rlike("(?i)<tbody"), F.regexp_extract(table, _BODY, 1)).otherwise(table)
    rows = sections.select(*kept, F.col("_section._titles").alias("_title"), F.explode(_all(body, _ROW)).alias("_row"))
    cells = rows.withColumn("_cells", F.transform(_all(F.col("_row"), _CELL), lambda c: F.regexp_replace(c, _TAG, "")))
    cells = cells.where(F.size("_cells") >= 3)
    stock = F.coalesce(F.get("_cells", 3), F.lit("Unknown"))
    plain = _plain("_title", F.get("_cells", 0), F.get("_cells", 1), F.get("_cells", 2), stock)
    texts = cells.withColumn("_plain", plain).select(*kept, "_plain.*")
    return texts.select(
        *kept,
        "product_name",
        "category",
        "section",
        parse_price(F.col("price_text")).cast("decimal(10,2)").alias("competitor_price"),
        "stock_status",
        (scraped_at if scraped_at is not None else F.lit(None).cast("timestamp_ntz")).alias("scraped_at"),
        (source if source is not None else F.lit(None).cast("string")).alias("source"),
    )

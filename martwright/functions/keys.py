"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: what a null key part is hashed as.
NULL_PART = "_dbt_utils_surrogate_key_null_"


def surrogate_key(*parts: str | Column) -> Column:
    """MD5 over the key parts joined by ``-``; null parts get a marker."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_PART)) for c in columns]))


def date_key(day: Column) -> Column:
    """Day as the integer ``YYYYMMDD``."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)

"""Exact money arithmetic.

Money stays decimal through every sum. A ratio is computed as double, taken to
eight decimals and only then rounded, so that the last shown digit never depends
on the binary representation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)
# Sixteen digits of a double are exact; the width leaves room for any ratio of money.
RATE = DecimalType(38, 8)


def money(value: Column) -> Column:
    """Round half up to cents and keep a width that fits a long."""
    return F.round(value, 2).cast(MONEY)


def settle(value: Column, scale: int) -> Column:
    """Round a double through its eight-decimal form."""
    return F.round(value.cast(RATE), scale)


def safe_ratio(numerator: Column, denominator: Column, scale: int = 2, times: int = 1) -> Column:
    """``numerator / denominator * times``; null where the denominator is zero."""
    quotient = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return settle(quotient * times if times != 1 else quotient, scale)


def mean(value: Column, scale: int) -> Column:
    """Aggregate: exact sum over count, rounded."""
    return settle(F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0)), scale)


def clamp(value: Column, low: float = 0, high: float = 1, default: float = 0) -> Column:
    """Limit to ``[low, high]``; null becomes ``default``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(default))))


def margin_pct(revenue: Column, cost: Column) -> Column:
    """Margin in percent of revenue; 0 where revenue is not positive."""
    return F.when(revenue > 0, safe_ratio(revenue - cost, revenue, 2, 100)).otherwise(F.lit(0).cast("decimal(38,2)"))


def gross_revenue(quantity: Column, unit_price: Column) -> Column:
    return money(quantity * unit_price)


def net_revenue(quantity: Column, unit_price: Column, discount: Column) -> Column:
    kept = F.lit(1).cast("decimal(5,4)") - F.coalesce(discount, F.lit(0).cast("decimal(5,4)"))
    return money(quantity * unit_price * kept)


def doubles(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double, for results that leave the engine."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )

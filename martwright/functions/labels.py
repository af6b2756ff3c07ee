"""Bands, tiers and display labels."""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column, functions as F

# Country to region, everything else is "Other".
COUNTRY_REGION = {
    "United States": "North America",
    "Canada": "North America",
    "United Kingdom": "Europe",
    "Germany": "Europe",
    "France": "Europe",
    "Australia": "APAC",
    "Japan": "APAC",
    "Singapore": "APAC",
    "India": "APAC",
    "UAE": "Middle East",
}

# Upper bounds (exclusive) of the price tiers.
PRICE_TIERS = [(50, "Budget"), (200, "Mid-range"), (500, "Premium")]
TOP_PRICE_TIER = "Luxury"

# Lower bounds (exclusive) in days of the tenure segments.
TENURE_SEGMENTS = [(365, "Loyal"), (90, "Regular")]
LOWEST_TENURE_SEGMENT = "New"

# Lower bounds (exclusive) of the spend segments.
SPEND_SEGMENTS = [(15000, "VIP"), (8000, "High Value"), (4000, "Mid Value")]
LOWEST_SPEND_SEGMENT = "Standard"

# Upper bounds (exclusive) of the lifetime-value bands.
CLV_BANDS = [(1000, "Standard (< $1k)"), (5000, "Mid Value ($1k–$5k)"), (15000, "High Value ($5k–$15k)")]
TOP_CLV_BAND = "VIP (> $15k)"

# Lower bounds (inclusive) in percent of the margin bands.
MARGIN_BANDS = [(40, "high"), (25, "medium")]
LOWEST_MARGIN_BAND = "low"

# Lower bounds (inclusive) of the RFM total per tier.
RFM_TIERS = [(13, "Champions"), (10, "Loyal"), (7, "Potential Loyal")]

# Statuses whose orders count as revenue.
REVENUE_STATUSES = ["Completed", "Shipped"]

SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8)}
LAST_SEASON = "Fall"


def _first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    label = None
    for condition, name in cases:
        label = F.when(condition, name) if label is None else label.when(condition, name)
    return label.otherwise(otherwise)


def _below(value: Column, bounds: list[tuple[int, str]], otherwise: str) -> Column:
    return _first_match([(value < bound, name) for bound, name in bounds], otherwise)


def _above(value: Column, bounds: list[tuple[int, str]], otherwise: str) -> Column:
    return _first_match([(value > bound, name) for bound, name in bounds], otherwise)


def _at_least(value: Column, bounds: list[tuple[int, str]], otherwise: str) -> Column:
    return _first_match([(value >= bound, name) for bound, name in bounds], otherwise)


def price_tier(price: Column) -> Column:
    return _below(price, PRICE_TIERS, TOP_PRICE_TIER)


def tenure_segment(days: Column) -> Column:
    return _above(days, TENURE_SEGMENTS, LOWEST_TENURE_SEGMENT)


def spend_segment(spend: Column) -> Column:
    return _above(spend, SPEND_SEGMENTS, LOWEST_SPEND_SEGMENT)


def clv_band(value: Column) -> Column:
    return _below(value, CLV_BANDS, TOP_CLV_BAND)


def margin_band(margin: Column) -> Column:
    return _at_least(margin, MARGIN_BANDS, LOWEST_MARGIN_BAND)


def country_region(country: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(COUNTRY_REGION.items())])
    return F.coalesce(F.try_element_at(lookup, country), F.lit("Other"))


def clv_tier(recency: Column, frequency: Column, monetary: Column) -> Column:
    total = recency + frequency + monetary
    cases = [(total >= bound, name) for bound, name in RFM_TIERS]
    cases += [(recency >= 4, "Recent"), ((frequency >= 4) | (monetary >= 4), "At Risk")]
    return _first_match(cases, "Hibernating")


def season(day: Column) -> Column:
    return _first_match([(F.month(day).isin(*months), name) for name, months in SEASONS.items()], LAST_SEASON)


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def fiscal_label(day: Column) -> Column:
    return F.concat(quarter_label(day), F.lit(" "), F.year(day).cast("string"))


def is_weekend(day: Column) -> Column:
    """Saturday or Sunday; Spark numbers the days 1 = Sunday to 7 = Saturday."""
    return F.dayofweek(day).isin(1, 7)


def relative_period(day: Column, as_of: dt.date) -> Column:
    """Position of a day relative to ``as_of``; weeks start on Monday."""
    week_start = as_of - dt.timedelta(days=as_of.weekday())
    return _first_match(
        [
            (day == F.lit(as_of), "Today"),
            (day == F.lit(as_of - dt.timedelta(days=1)), "Yesterday"),
            (day >= F.lit(week_start), "This Week"),
            (day >= F.lit(as_of.replace(day=1)), "This Month"),
        ],
        "Prior",
    )


def price_direction(delta: Column) -> Column:
    """Arrow and absolute difference against the competitor, N/A without one."""
    arrow = F.when(delta < 0, "▼ $").otherwise("▲ $")
    return F.when(delta.isNull(), "N/A").otherwise(F.concat(arrow, F.abs(delta.cast("decimal(18,2)")).cast("string")))


def format_growth(pct: Column) -> Column:
    """``+x%``, ``-x%`` or a dash for no previous period."""
    shown = F.concat(pct.cast("string"), F.lit("%"))
    return F.when(pct.isNull(), "—").when(pct >= 0, F.concat(F.lit("+"), shown)).otherwise(shown)


def format_money(value: Column, scale: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, scale))


def format_pct(value: Column, scale: int = 1) -> Column:
    return F.concat(F.format_number(value, scale), F.lit("%"))

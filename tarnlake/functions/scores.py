"""Scores, levels and classes of the reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spending tiers, alert thresholds and gauge thresholds.
SPEND_TIERS = ((1000, "0.9"), (500, "0.7"))
SPEND_BASE = "0.5"
ALERT_LEVELS = ((1000, "HIGH"), (500, "MEDIUM"))
ALERT_BASE = "LOW"
ALERT_THRESHOLD = "1000.0"
GAUGE_THRESHOLDS = ((90, "red"), (70, "yellow"))
GAUGE_BASE = "green"


def greatest_or_null(*columns: Column) -> Column:
    """The greatest argument, or NULL as soon as one is NULL (Spark's own skips NULLs)."""
    any_null = columns[0].isNull()
    for column in columns[1:]:
        any_null = any_null | column.isNull()
    return F.when(~any_null, F.greatest(*columns))


def spend_score(total_spent: Column) -> Column:
    """0.9 above 1000 spent, 0.7 above 500, else 0.5."""
    score = F
    for bound, value in SPEND_TIERS:
        score = score.when(total_spent > bound, F.lit(Decimal(value)))
    return score.otherwise(F.lit(Decimal(SPEND_BASE))).cast("decimal(5,4)")


def alert_level(count: Column, seconds: int) -> Column:
    """HIGH above 1000 per second, MEDIUM above 500, else LOW; compared before any rounding."""
    level = F
    for bound, name in ALERT_LEVELS:
        level = level.when(count > bound * seconds, F.lit(name))
    return level.otherwise(F.lit(ALERT_BASE))


def threshold_class(percent: Column) -> Column:
    """red from 90, yellow from 70, else green; NULL stays NULL."""
    colour = F.when(percent.isNull(), F.lit(None).cast("string"))
    for bound, name in GAUGE_THRESHOLDS:
        colour = colour.when(percent >= bound, F.lit(name))
    return colour.otherwise(F.lit(GAUGE_BASE))


def presence_score(count: Column) -> Column:
    """100 if there is any row, else 0."""
    return F.when(count > 0, F.lit(Decimal("100.0"))).otherwise(F.lit(Decimal("0.0"))).cast("decimal(5,2)")


def completeness_score(count: Column, nulls: Column) -> Column:
    """Percentage of rows that are not NULL, 0 for an empty table."""
    share = (count - nulls).cast("decimal(20,0)") * F.lit(Decimal("100.0")) / F.nullif(count, F.lit(0))
    return F.when(count > 0, share).otherwise(F.lit(Decimal("0"))).cast("decimal(5,2)")

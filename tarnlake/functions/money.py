"""Money with two decimals, added up as whole cents.

``DECIMAL(10,2) * INT`` is ``DECIMAL(21,2)`` in Spark, which no longer fits a machine word: every
row would go through big-decimal objects. Prices have two decimals, so their cents are whole
numbers; products and sums of them are exact in a BIGINT and stay in generated code. A sum outside
BIGINT raises (ANSI mode), it never wraps; DECIMAL(15,2), the type of the summary tables, ends
10,000 times earlier.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cents(price: str | Column) -> Column:
    """A price of two decimals as a whole number of cents."""
    price = F.col(price) if isinstance(price, str) else price
    return (price.cast("decimal(10,2)") * F.lit(Decimal("100"))).cast("bigint")


def from_cents(cents: Column, precision: int = 15) -> Column:
    """Cents back to ``DECIMAL(precision, 2)``."""
    return (cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")


def average_of_cents(total: Column, count: Column, precision: int = 10) -> Column:
    """``total / count`` rounded half up (away from zero) to the cent; NULL for no rows.

    Integer division avoids rounding twice, first to the scale of AVG and then to the target type.
    """
    rounded = F.call_function("div", 2 * F.abs(total) + count, 2 * F.nullif(count, F.lit(0)))
    return from_cents(F.signum(total).cast("bigint") * rounded, precision)

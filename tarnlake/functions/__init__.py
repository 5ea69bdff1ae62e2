"""Column helpers; all of them are built-in expressions, so they stay inside generated code."""

from tarnlake.functions.money import average_of_cents, from_cents, to_cents
from tarnlake.functions.moments import (
    day_of,
    days_before,
    interval_seconds,
    moment,
    ntz_columns,
    since,
)
from tarnlake.functions.scores import (
    alert_level,
    completeness_score,
    greatest_or_null,
    presence_score,
    spend_score,
    threshold_class,
)

__all__ = [
    "alert_level",
    "average_of_cents",
    "completeness_score",
    "day_of",
    "days_before",
    "from_cents",
    "greatest_or_null",
    "interval_seconds",
    "moment",
    "ntz_columns",
    "presence_score",
    "since",
    "spend_score",
    "threshold_class",
    "to_cents",
]

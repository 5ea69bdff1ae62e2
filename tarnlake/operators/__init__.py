"""Operators shared by the jobs."""

from tarnlake.operators.asof import as_of_join
from tarnlake.operators.grouping import (
    counted_by,
    distinct_per_group,
    latest_per_key,
    top_rows,
)

__all__ = ["as_of_join", "counted_by", "distinct_per_group", "latest_per_key", "top_rows"]

"""The ``as_of`` moment that stands for "now" in every job with a look-back."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AsOf = str | datetime | date | None


def moment(as_of: AsOf, data_type: T.DataType | None = None) -> Column:
    """``as_of`` as a literal of the given type (no-zone timestamp by default).

    None means the current time. The literal has the type of the column it is compared with, so
    that the column itself is never cast and the comparison still reaches the Parquet reader.
    """
    data_type = data_type or T.TimestampNTZType()
    if as_of is None:
        now = F.localtimestamp() if isinstance(data_type, T.TimestampNTZType) else F.current_timestamp()
        return now.cast(data_type)
    return F.lit(str(as_of)).cast("timestamp_ntz").cast(data_type)


def day_of(as_of: AsOf) -> Column:
    """The calendar day of ``as_of``."""
    return F.to_date(moment(as_of))


def days_before(as_of: AsOf, days: int) -> Column:
    """The calendar day ``days`` days before ``as_of``."""
    return F.date_sub(day_of(as_of), days)


# The day columns by which tables with such a time column are partitioned.
_DAY_COLUMNS = {"window_start": "window_date", "event_time": "event_date"}


def since(df: DataFrame, time_column: str, as_of: AsOf, look_back: str) -> Column:
    """``time_column >= as_of - look_back``; the bound folds to a constant.

    In a table partitioned by the day of that time the filter also names the day, which leaves only
    the folders of the look-back to be listed and read.
    """
    bound = moment(as_of, df.schema[time_column].dataType) - F.expr(f"INTERVAL {look_back}")
    recent = F.col(time_column) >= bound
    day = _DAY_COLUMNS.get(time_column)
    return recent & (F.col(day) >= F.to_date(bound)) if day in df.columns else recent


# Seconds per unit of a look-back.
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def interval_seconds(look_back: str) -> int:
    """Seconds of a look-back such as ``1 minute`` or ``7 days``."""
    amount, unit = look_back.split()
    return int(amount) * _UNIT_SECONDS[unit.rstrip("s").lower()]


def ntz_columns(df: DataFrame) -> DataFrame:
    """Zoned timestamp columns (streams need them for watermarks) as no-zone ones."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})

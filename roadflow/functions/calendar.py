"""Time parsing, flooring and calendar features on timezone-naive stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

LOCAL_ZONE = "Asia/Ho_Chi_Minh"

# Public holidays kept every year, as month * 100 + day.
YEARLY_HOLIDAYS = [101, 430, 501, 902]
# Further public holidays of 2026, as month * 100 + day.
HOLIDAYS_2026 = [
    214, 215, 216, 217, 218, 219, 220, 221, 222,
    425, 426, 427, 502, 503, 829, 830, 831, 901,
]


def step_seconds(step: str) -> int:
    """'5 minutes', '1 hour', '1 day' as seconds."""
    amount, unit = step.split()
    size = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * size


def epoch(c) -> Column:
    """Whole seconds of a naive stamp (the session zone is UTC)."""
    return F.unix_seconds(col(c).cast("timestamp"))


def from_epoch(c) -> Column:
    return F.timestamp_seconds(col(c)).cast("timestamp_ntz")


def floor_to(c, step: str) -> Column:
    """Floor to a multiple of ``step``; null stays null."""
    size = step_seconds(step)
    seconds = epoch(c)
    return from_epoch(seconds - F.pmod(seconds, F.lit(size)))


def add_steps(c, n, step: str) -> Column:
    """Stamp ``n`` steps later; ``n`` may be a column."""
    offset = (n if isinstance(n, Column) else F.lit(n)) * step_seconds(step)
    return from_epoch(epoch(c) + offset)


def parse_bucket_time(c) -> Column:
    """Text to naive stamp on the minute: offsets go to local time, junk to null."""
    text = F.trim(col(c).cast("string"))
    with_offset = text.rlike(r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$")
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    local = F.from_utc_timestamp(colon.try_cast("timestamp"), LOCAL_ZONE).cast("timestamp_ntz")
    parsed = F.when(with_offset, local).otherwise(text.try_cast("timestamp_ntz"))
    return floor_to(parsed, "1 minute")


def is_holiday(c) -> Column:
    code = F.month(col(c)) * 100 + F.dayofmonth(col(c))
    every_year = code.isin(YEARLY_HOLIDAYS)
    extra = (F.year(col(c)) == 2026) & code.isin(HOLIDAYS_2026)
    return (every_year | extra).cast("int")


def calendar(c) -> dict[str, Column]:
    """Calendar features; Monday is day 0."""
    weekday = F.weekday(col(c))
    return {
        "Hour": F.hour(col(c)),
        "DayOfWeek": weekday,
        "IsHoliday": is_holiday(c),
        "IsWeekend": (weekday >= 5).cast("int"),
        "Day": F.dayofmonth(col(c)),
        "Month": F.month(col(c)),
    }


def with_calendar(df: DataFrame, time_col: str = "BucketTime") -> DataFrame:
    return df.withColumns(calendar(time_col))


DUMMY_COLS = [f"Hour_{h}" for h in range(1, 24)] + [f"DoW_{d}" for d in range(1, 7)]


def calendar_dummies(c) -> dict[str, Column]:
    """One-hot hour and weekday on a fixed vocabulary, first level left out."""
    hours = {f"Hour_{h}": (F.hour(col(c)) == h).cast("int") for h in range(1, 24)}
    days = {f"DoW_{d}": (F.weekday(col(c)) == d).cast("int") for d in range(1, 7)}
    return {**hours, **days}

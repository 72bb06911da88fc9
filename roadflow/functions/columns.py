"""Column expressions for cleaning and arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASS_TO_CATEGORY


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct, by scalar subquery.

    Facts about a whole table (span, medians, verdicts) reach every row this way; they are
    computed once and never joined.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()


def normalize_key(c) -> Column:
    """Trimmed upper-case text; '', 'NAN' and 'NONE' become null."""
    text = F.upper(F.trim(col(c).cast("string")))
    return F.when(~text.isin("", "NAN", "NONE"), text)


def to_number(c) -> Column:
    """Double, with junk and NaN as null."""
    number = col(c).try_cast("double")
    return F.when(~F.isnan(number), number)


def non_negative(c) -> Column:
    return F.when(col(c) >= 0, col(c))


def in_range(c, low: float, high: float) -> Column:
    return F.when(col(c).between(low, high), col(c))


def out_of_range(c, low: float, high: float) -> Column:
    """True only for a present value outside the range."""
    return F.coalesce(~col(c).between(low, high), F.lit(False))


def clip_low(c, low: float = 0.0) -> Column:
    """Lower bound that keeps null (``greatest`` alone would drop it)."""
    return F.when(col(c) < low, F.lit(low)).otherwise(col(c))


def clip(c, low: float, high: float) -> Column:
    return F.when(col(c) < low, F.lit(low)).when(col(c) > high, F.lit(high)).otherwise(col(c))


def ratio_or_zero(part, total) -> Column:
    return F.when(col(total) > 0, col(part) / col(total)).otherwise(F.lit(0.0))


def ratio_or_null(part, total) -> Column:
    return F.when(col(total) != 0, col(part) / col(total))


def percent_change(now, before) -> Column:
    """Change in percent, 0 where the base is not positive."""
    return F.when(col(before) > 0, (col(now) - col(before)) / col(before) * 100.0).otherwise(0.0)


def half_even(c) -> Column:
    """Round half to even, as a long (``rint`` stays in generated code)."""
    return F.rint(col(c)).cast("long")


def vehicle_category(code) -> Column:
    pairs = [F.lit(x) for kv in CLASS_TO_CATEGORY.items() for x in kv]
    rounded = half_even(code).cast("int")
    return F.coalesce(F.create_map(*pairs)[rounded], F.lit("OtherVehicle"))


def short_id(c) -> Column:
    return F.substring(col(c), 1, 8)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, [col(c) for c in columns])


def order_text_to_struct(c) -> Column:
    """The numbers of a written order, '(p, d, q)' or '(P, D, Q, s)', as an array."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(-?\d+)"), F.lit(1)), lambda v: v.cast("int"))


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))

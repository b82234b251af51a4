"""Parsing of text fields into whole numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
NAMED = r"(?i)^[+-]?(inf|infinity|nan)\z"
LONG_MAX = (1 << 63) - 1


def epoch_millis(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp since 1970, truncated; any session time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def time_millis(text: Column) -> Column:
    """``dd/MM/yyyy hh:mm:ss a.m.`` (or p.m.) in UTC as epoch milliseconds; null if it is no such time."""
    plain = F.replace(F.replace(text, F.lit("a.m."), F.lit("am")), F.lit("p.m."), F.lit("pm"))
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.to_timestamp_ntz(F.when(F.try_to_timestamp(plain, F.lit("d/M/yyyy h:m:s a")).isNotNull(), plain), F.lit("d/M/yyyy h:m:s a")))


def fixed_point(text: Column) -> Column:
    """A decimal text times 1000, truncated. Empty is 0; negative and NaN are 0; beyond the type its largest; null if no number."""
    special, number = text.rlike(NAMED), F.when(text.rlike(NUMBER), text).cast("double") * 1000
    infinite = special & ~F.lower(text).contains("nan") & ~text.startswith("-")
    return (
        F.when(text == "", F.lit(0))
        .when(infinite, F.lit(LONG_MAX))
        .when(special, F.lit(0))
        .when(number.isNull(), F.lit(None).cast("long"))
        .when(number < 0, F.lit(0))
        .when(number >= float(1 << 63), F.lit(LONG_MAX))
        .otherwise(F.when(number < float(1 << 63), number).cast("long"))
    ).cast("long")


def fixed_point_number(value: Column) -> Column:
    """The same for a double."""
    scaled = value * 1000
    return F.when(scaled.isNull() | F.isnan(scaled) | (scaled < 0), F.lit(0)).when(scaled >= float(1 << 63), F.lit(LONG_MAX)).otherwise(F.when(scaled < float(1 << 63), scaled).cast("long")).cast("long")

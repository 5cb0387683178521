"""Calendar and clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(c: Column) -> Column:
    """Timestamp or null; bad text becomes null."""
    return F.try_to_timestamp(c.cast("string"))


def parse_double(c: Column) -> Column:
    """Double or null; bad text and NaN become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def day(ts: Column) -> Column:
    return F.to_date(ts)


def day_name(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def week_ending_sunday(d: Column) -> Column:
    return F.date_add(F.to_date(F.date_trunc("week", d)), 6)


def month_end(d: Column) -> Column:
    return F.last_day(d)


def time_of_day(ts: Column) -> Column:
    """Morning from 5, Afternoon from 12, Evening from 17, Night from 21."""
    h = F.hour(ts)
    return (
        F.when((h >= 5) & (h < 12), "Morning")
        .when((h >= 12) & (h < 17), "Afternoon")
        .when((h >= 17) & (h < 21), "Evening")
        .otherwise("Night")
    )


def six_hour_bucket(ts: Column) -> Column:
    """Night 00-06, Morning 06-12, Afternoon 12-18, Evening 18-24 (used by the tier model)."""
    h = F.hour(ts)
    return (
        F.when(h < 6, "Night").when(h < 12, "Morning").when(h < 18, "Afternoon").otherwise("Evening")
    )


def iso_text(ts: Column) -> Column:
    """ISO 8601 without zone; seconds always, microseconds only when present."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours, to the second."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return seconds / F.lit(3600.0)

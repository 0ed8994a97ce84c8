"""Calendar columns. Timestamps are in the session's zone, which is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def quarter(ts: Column) -> Column:
    """YYYY-Qn."""
    return F.concat(year(ts), F.lit("-Q"), F.quarter(ts).cast("string"))


def period_ordinal(period: Column) -> Column:
    """Months or quarters since year 0 of YYYY-MM or YYYY-Qn; null if it is neither."""
    y = F.regexp_extract(period, r"^(\d{4})-(?:Q[1-4]|(?:0[1-9]|1[0-2]))$", 1)
    q = F.regexp_extract(period, r"^\d{4}-Q([1-4])$", 1)
    m = F.regexp_extract(period, r"^\d{4}-(0[1-9]|1[0-2])$", 1)
    return F.when(q != "", y.try_cast("int") * 4 + q.try_cast("int") - 1).when(m != "", y.try_cast("int") * 12 + m.try_cast("int") - 1)


def period_of(ordinal: Column, quarterly: bool) -> Column:
    n = 4 if quarterly else 12
    y, k = F.floor(ordinal / n), F.pmod(ordinal, F.lit(n)) + 1
    tail = F.concat(F.lit("Q"), k.cast("string")) if quarterly else F.lpad(k.cast("string"), 2, "0")
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), tail)


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


def age_months(ts: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / (30.44 * 86400)


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"interval {int(days)} days")


def months_before(as_of: Column, months: int) -> Column:
    return as_of - F.expr(f"interval {int(months)} months")


def fresh(ts: Column, as_of: Column, days: int) -> Column:
    """Seen within so many days before as_of; never, if it isn't known when."""
    return F.coalesce(ts > days_before(as_of, days), F.lit(False))


def read_date(s: Column) -> Column:
    """A timestamp of d.MM.yyyy, an ISO date or time, or seconds or milliseconds since 1970; else null."""
    s = F.trim(s)
    number = s.try_cast("long")
    seconds = F.when(F.abs(number) >= 100_000_000_000, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.coalesce(F.try_to_timestamp(s, F.lit("d.M.yyyy")), F.try_to_timestamp(s, F.lit("d.MM.yyyy")), F.try_to_timestamp(s)))

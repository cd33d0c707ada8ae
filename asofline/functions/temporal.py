"""The two cutoffs of a date, and what is knowable at it.

Instants (news, posts) are knowable until the date's last second in New York; rows that are known by the day
(filings, and one news source's) until the end of the calendar day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Fixed value: the source whose articles are dated by the day.
DAY_SOURCE = "GDELT Cloud"


def as_date(value: str | dt.date, today: dt.date | None = None) -> dt.date:
    """A date that isn't in the future."""
    day = dt.date.fromisoformat(value) if isinstance(value, str) else value
    if day > (today or dt.datetime.now(dt.UTC).date()):
        raise ValueError(f"{day} is in the future")
    return day


def column(day: Column | str | dt.date) -> Column:
    return day if isinstance(day, Column) else F.lit(str(day)).cast("date")


def instant_cutoff(day: Column | str | dt.date) -> Column:
    """The last second of the day in New York as a UTC timestamp."""
    return F.to_utc_timestamp(F.date_add(column(day), 1).cast("timestamp") - F.expr("interval 1 second"), ZONE)


def day_after(day: Column | str | dt.date) -> Column:
    """Midnight UTC of the next day, an exclusive bound."""
    return F.date_add(column(day), 1).cast("timestamp")


def knowable_filing(filed_at: Column, day: Column | str | dt.date) -> Column:
    return filed_at < day_after(day)


def knowable_news(published_at: Column, source: Column, day: Column | str | dt.date) -> Column:
    by_day = F.coalesce(source, F.lit("")).contains(DAY_SOURCE)
    return (published_at <= instant_cutoff(day)) & (~by_day | (published_at < day_after(day)))


def from_source(source: Column, provider: str) -> Column:
    """Whether a row belongs to a provider: alphavantage, marketaux, or anything else, which means gdelt."""
    needle = {"alphavantage": "alpha vantage", "marketaux": "marketaux"}.get(provider.strip().lower(), "gdelt")
    return F.lower(F.coalesce(source, F.lit(""))).contains(needle)


def sql_cutoff(day: str) -> str:
    """instant_cutoff() in SQL, of a date expression."""
    return f"((({day}) + INTERVAL 1 DAY - INTERVAL 1 SECOND) AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC')"


def sql_knowable_news(day: str) -> str:
    return f"(published_at <= {sql_cutoff(day)} AND (source NOT LIKE '%{DAY_SOURCE}%' OR published_at < ({day}) + INTERVAL 1 DAY))"

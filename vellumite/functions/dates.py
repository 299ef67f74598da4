"""Dates of documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_utc(value: Column) -> Column:
    """An ISO date or date and time as UTC text; null for anything else. The session's zone is UTC."""
    return F.date_format(F.to_utc_timestamp(value.try_cast("timestamp"), F.current_timezone()), _FORMAT)


def archive_time(value: Column) -> Column:
    """The date as archives can hold it: from 1980 to 2107."""
    return F.when(value < "1980", "1980-01-01T00:00:00Z").when(value >= "2108", "2107-12-31T23:59:58Z").otherwise(value)

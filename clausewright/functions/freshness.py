"""Staleness and re-verification, always evaluated at an explicit date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions.text import ws_trim
from clausewright.schema import REVERIFY_AFTER_DAYS


def as_date(as_of: str | dt.date | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def clean_superseded(col: Column) -> Column:
    """Blank becomes NULL, anything else is stripped."""
    return F.nullif(ws_trim(col), F.lit(""))


def is_stale(superseded_by: Column, expiry_date: Column, as_of=None) -> Column:
    expired = F.coalesce(as_date(as_of) > expiry_date, F.lit(False))
    return clean_superseded(superseded_by).isNotNull() | expired


def days_since_verified(last_verified: Column, as_of=None) -> Column:
    return F.datediff(as_date(as_of), last_verified)


def needs_reverification(last_verified: Column, as_of=None) -> Column:
    return days_since_verified(last_verified, as_of) > REVERIFY_AFTER_DAYS

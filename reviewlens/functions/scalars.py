"""Clean-up and time-bucket expressions.

Each function takes and returns a ``Column``; all are built from Spark's own
functions so Catalyst can fold, push and code-generate them.  ``try_*``
variants are used because ANSI mode (on by default in Spark 4) turns a bad
cast into an error, while the clean-up wants a sentinel instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlens.functions import dates
from reviewlens.schemas import MISSING_NUMBER

# ---------------------------------------------------------------------------
# The accepted text shapes.
# Price: skip everything up to the first digit, then the whole rest must be a
# number (digits with optional thousands commas, optional fraction, optional
# exponent, trailing blanks allowed).
PRICE_PATTERN = r"^[^\p{Nd}]*(\d[\d,]*(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*$"
# Rank: the first run of digits with optional thousands commas.
RANK_PATTERN = r"\p{Nd}+(,\p{Nd}+)*"
# ---------------------------------------------------------------------------

SECONDS_PER_DAY = 86400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_to_float(price: Column | str) -> Column:
    """Price text to float; -1 when there is no parsable number."""
    digits = F.regexp_extract(_col(price), PRICE_PATTERN, 1)
    number = F.replace(digits, F.lit(","), F.lit("")).try_cast("float")
    return F.coalesce(number, F.lit(MISSING_NUMBER).cast("float"))


def rank_to_long(rank: Column | str) -> Column:
    """First digit run (commas removed) as a long; -1 when absent or too big."""
    run = F.regexp_extract(_col(rank), RANK_PATTERN, 0)
    number = F.replace(run, F.lit(","), F.lit("")).try_cast("bigint")
    return F.coalesce(number, F.lit(MISSING_NUMBER).cast("bigint"))


def date_to_epoch(date: Column | str, order: str = "month first") -> Column:
    """Date text to epoch seconds (double, UTC); -1 when it is no date (``dates.py``)."""
    return dates.date_to_epoch(_col(date), MISSING_NUMBER, order)


def epoch_day(unix_time: Column | str) -> Column:
    """Calendar date (UTC) of an epoch-seconds value, independent of the session zone."""
    return F.date_from_unix_date(F.floor(_col(unix_time) / SECONDS_PER_DAY).cast("int"))


def calendar_year(unix_time: Column | str) -> Column:
    return F.year(epoch_day(unix_time))


def week_year(unix_time: Column | str) -> Column:
    """US week-based year: the year of the Saturday that ends the date's week.

    This is what the pattern ``YYYY`` meant to the Spark 2.x formatter the
    source application ran on (weeks start on Sunday, week 1 holds 1 January).
    """
    d = epoch_day(unix_time)
    return F.year(F.date_add(d, F.lit(7) - F.dayofweek(d)))


def month_of_year(unix_time: Column | str) -> Column:
    return F.month(epoch_day(unix_time))

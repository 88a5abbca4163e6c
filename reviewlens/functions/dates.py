"""Date text to epoch seconds, by one grammar instead of a list of patterns.

A date is an optional weekday, a day in one of four orders, and optionally a
time of day (24 or 12 hours, seconds and fractions optional) and a zone.  One
regular expression pass names the parts; numbers are put together by
``try_make_timestamp``, so that a 31 June or a 25th hour is no date.  A numeric
date with the year last is read in the culture's order.  Without a zone the
time is UTC, whatever the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The names and orders that dates are written with.
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
ORDERS = {"month first": ("month", "day"), "day first": ("day", "month")}
# ---------------------------------------------------------------------------

_PARTS = ("name", "day", "former", "latter", "month", "year", "hour", "minute", "sec", "fraction", "half", "zone")
_MARK = "\u0001"


def _name(words: list[str], more: str = "") -> str:
    """Full names and their first three letters."""
    return "|".join(f"{w[:3]}(?:{w[3:]})?" if w[3:] else w for w in words) + more


def grammar() -> str:
    """The pattern of a whole text; a part that several orders have is numbered."""
    month = _name(MONTHS, "|Sept")
    day, year, blank = r"\d{1,2}", r"\d{4}", r"[\s,]+"
    dates = "|".join((
        rf"(?<name1>{month})\.?{blank}(?<day1>{day})(?:st|nd|rd|th)?{blank}(?<year1>{year})",
        rf"(?<day2>{day})(?:st|nd|rd|th)?[\s,.-]+(?<name2>{month})\.?[\s,-]+(?<year2>{year})",
        rf"(?<former1>{day})[/.-](?<latter1>{day})[/.-](?<year3>{year})",
        rf"(?<year4>{year})[/.-](?<month1>{day})[/.-](?<day3>{day})"))
    clock = (r"(?<hour1>\d{1,2})(?::(?<minute1>\d{2})(?::(?<sec1>\d{2})(?:\.(?<fraction1>\d{1,9}))?)?)?"
             r"\s*(?<half1>[ap])\.?m\.?|"
             r"(?<hour2>\d{1,2}):(?<minute2>\d{2})(?::(?<sec2>\d{2})(?:\.(?<fraction2>\d{1,9}))?)?")
    return (rf"(?i)^\s*(?:(?:{_name(WEEKDAYS)})\.?{blank})?(?:{dates})"
            rf"(?:(?:T|{blank})(?:{clock})\s*(?<zone1>Z|GMT|UTC|[+-]\d{{2}}(?::?\d{{2}})?)?)?\s*$")


def _parts(text: Column) -> Column:
    """The parts of a date text as an array in the order of ``_PARTS``; another text gives an array of one."""
    pattern = grammar()
    filled = _MARK + _MARK.join("".join(f"${{{p}{i}}}" for i in range(1, 5) if f"<{p}{i}>" in pattern) for p in _PARTS)
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(filled)), _MARK)


def date_to_epoch(date: Column | str, missing: float, order: str = "month first") -> Column:
    """Epoch seconds (double) of a date text, ``missing`` where it is none."""
    text = F.col(date) if isinstance(date, str) else date
    parts = _parts(F.when(~F.contains(text, F.lit(_MARK)), text))

    def seconds(held: Column) -> Column:
        part = {p: held[i + 1] for i, p in enumerate(_PARTS)}

        def number(name: str) -> Column:
            return part[name].try_cast("int")
        named = F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]),
                                 F.lower(F.left(part["name"], F.lit(3)))).cast("int")
        numeric = {p: number(n) for p, n in zip(ORDERS[order], ("former", "latter"), strict=True)}
        month = F.coalesce(F.when(part["name"] != "", named), number("month"), numeric["month"])
        day = F.coalesce(number("day"), numeric["day"])
        hour, afternoon = number("hour"), F.lower(part["half"]) == "p"
        twelve = F.when(hour.between(1, 12), hour % 12 + F.when(afternoon, 12).otherwise(0))
        hour = F.when(part["half"] != "", twelve).otherwise(F.coalesce(hour, F.lit(0)))
        second = F.concat(F.when(part["sec"] != "", part["sec"]).otherwise(F.lit("0")), F.lit("."),
                          F.rpad(F.left(part["fraction"], F.lit(6)), 6, "0")).cast("decimal(16,6)")
        second = F.when(second < 60, second)
        made = F.call_function("try_make_timestamp", number("year"), month, day, hour,
                               F.coalesce(number("minute"), F.lit(0)), second, F.lit("UTC"))
        zone = F.regexp_replace(part["zone"], ":", "")
        sign = F.when(F.left(zone, F.lit(1)) == "-", -1).otherwise(1)
        offset = F.when(zone.rlike("^[+-]"), sign * (
            F.substring(zone, 2, 2).try_cast("int") * 3600
            + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0)) * 60)).otherwise(0)
        return F.when(F.size(held) == len(_PARTS) + 1, F.unix_micros(made).cast("double") / 1e6 - offset)

    # the parts are split once
    return F.coalesce(F.transform(F.array(parts), seconds)[0], F.lit(float(missing)))

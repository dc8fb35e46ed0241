"""Whether a text is a real date, as column expressions.

A form is a pattern with a year, a month and a day part; a text is a date if it has
a form and that day exists in a plausible year. ``as_of`` is the year dates are
judged in, so that results do not depend on when a job runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months, and the earliest year and the number of years ahead that are plausible.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
EARLIEST, AHEAD = 1850, 10
_NAME = "(" + "|".join(f"{m}|{m[:3]}" if m != "May" else m for m in MONTHS) + ")"
#: (pattern, its groups for year, month and day): numbers may be month or day first.
FORMS = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", (3, 1, 2)), (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", (3, 2, 1)), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 1, 2)), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)), (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)), (rf"(?i)^(\d{{1,2}})-{_NAME}-(\d{{4}})$", (3, 2, 1)), (rf"(?i)^(\d{{1,2}}) {_NAME} (\d{{4}})$", (3, 2, 1)),
    (rf"(?i)^{_NAME} (\d{{1,2}}),? (\d{{4}})$", (3, 1, 2)),
)
_CLOCK = r"(?: |T)(?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d{1,6})?)?(?: ?[AaPp][Mm])?(?:Z|[+-]\d{2}:?\d{2})?$"
_TIME = r"(?i)^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s*[AP]M)?$"
_WEEKDAY = r"(?i)^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+"


def exists(y: Column, m: Column, d: Column) -> Column:
    """Whether the day exists; nulls do not."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))


def plausible(y: Column, as_of: int) -> Column:
    return y.between(EARLIEST, as_of + AHEAD)


def _number(part: Column) -> Column:
    """A month's number by name or figures, any other number, or null."""
    named = F.coalesce(*[F.when(F.lower(F.substring(part, 1, 3)) == m[:3].lower(), F.lit(i)) for i, m in enumerate(MONTHS, 1)])
    return F.coalesce(named, part.try_cast("int"))


def _year(part: Column) -> Column:
    y = part.try_cast("int")
    return F.when(F.length(part) == 2, F.when(y >= 69, y + 1900).otherwise(y + 2000)).otherwise(y)


def _tidy(v: Column) -> Column:
    v = F.regexp_replace(F.trim(F.regexp_replace(v, r"\s+", " ")), _WEEKDAY, "")
    return F.regexp_replace(v, r"(?i)\s+at\s+", " ")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def _in_form(day: Column, pattern: str, groups: tuple[int, int, int], as_of: int) -> Column:
    part = [F.nullif(F.regexp_extract(day, pattern, g), F.lit("")) for g in groups]
    ymd = F.struct(_let(part[0], _year).alias("y"), _let(part[1], _number).alias("m"), _let(part[2], _number).alias("d"))
    held = _let(ymd, lambda x: exists(x["y"], x["m"], x["d"]) & F.coalesce(plausible(x["y"], as_of), F.lit(False)))
    # most texts have no form at all: their parts are not taken out
    return F.when(day.rlike(pattern), held).otherwise(F.lit(False))


def is_real_date(v: Column, as_of: int, with_time: Column | bool = False) -> Column:
    """Dates in one of FORMS; with ``with_time``, also a clock time, alone or behind a date."""
    timed = F.lit(with_time) if isinstance(with_time, bool) else with_time

    def judge(v: Column) -> Column:
        day = F.when(timed | v.rlike(r"^\d{4}-?\d{2}-?\d{2}[ T]"), F.regexp_replace(v, _CLOCK, "")).otherwise(v)
        forms = lambda day: F.exists(F.array(*[_in_form(day, p, g, as_of) for p, g in FORMS]), lambda x: x)
        return _let(day, forms) | (timed & v.rlike(_TIME))

    return _let(_tidy(v), judge)


def is_real_date_range(v: Column, as_of: int) -> Column:
    """"Month d-d, yyyy" with both days in the month, in order."""
    pattern = r"^([A-Za-z]+)\s+(\d{1,2})\s*[-–]\s*(\d{1,2}),?\s+(\d{4})$"
    part = lambda g: F.nullif(F.regexp_extract(F.trim(v), pattern, g), F.lit(""))
    y, m, a, b = part(4).try_cast("int"), _number(part(1)), part(2).try_cast("int"), part(3).try_cast("int")
    return exists(y, m, a) & exists(y, m, b) & F.coalesce((a <= b) & plausible(y, as_of), F.lit(False))

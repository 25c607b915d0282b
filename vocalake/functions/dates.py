"""Date and time expressions. "Now" is always an argument, so jobs repeat exactly."""
from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F

from .text import normalize_whitespace

GRANULARITIES = ("day", "week", "month", "quarter", "year")

# Wording of relative dates and the length of their units in seconds
# (a month counts 30 days, a year 365).
_RELATIVE = r"(?iu)^(?:modifi[eé] )?il y a (un|une|\d+) (minute|heure|jour|semaine|mois|an)s?$"
_UNIT_SECONDS = {
    "minute": 60, "heure": 3_600, "jour": 86_400, "semaine": 604_800, "mois": 2_592_000, "an": 31_536_000,
}
_YEAR_ONE = -62_135_596_800  # epoch second of 0001-01-01


def epoch_micros(now: datetime) -> int:
    """Microseconds since the epoch; a naive datetime is read as UTC."""
    aware = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    delta = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def parse_relative_french(col: Column, now: datetime) -> Column:
    """UTC timestamp of texts such as "il y a 2 ans" or "Modifié il y a une semaine".

    Anything else, and ages that reach before the year 1, give null.
    """
    clean = F.lower(normalize_whitespace(col))
    quantity = F.regexp_replace(F.regexp_extract(clean, _RELATIVE, 1), "^une?$", "1").try_cast("long")
    unit_micros = F.create_map(*[F.lit(v) for pair in _UNIT_SECONDS.items() for v in (pair[0], pair[1] * 1_000_000)])
    age = F.try_multiply(quantity, F.try_element_at(unit_micros, F.regexp_extract(clean, _RELATIVE, 2)))
    earliest = F.lit(_YEAR_ONE * 1_000_000)
    moment = F.greatest(F.try_subtract(F.lit(epoch_micros(now)), age), earliest)
    return F.timestamp_micros(F.nullif(moment, earliest))


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "month")


def period(col: Column, granularity: str) -> Column:
    """First day of the period a date falls in; unknown granularity means month."""
    unit = granularity if granularity in GRANULARITIES else "month"
    day = col.cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def days_ago(days: int, today: date) -> Column:
    return F.date_sub(F.lit(today), days)


def parse_date_dayfirst(col: Column) -> Column:
    """Lenient timestamp: ISO first, then day-first forms; everything else null.

    Separators may be dash, dot or slash in either order, years may have two digits (69 to 99 mean
    the last century) and months may be English names or their first three letters.
    """
    text = F.btrim(col.cast("string"))
    text = F.regexp_replace(text, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
    named = F.regexp_replace(text, r"^(\d{1,2})[ .-]+([A-Za-z]{3})[a-z]*[ .,-]+(\d{4})", "$1 $2 $3")
    day, month, rest = r"^(\d{1,2})[./-]", r"(\d{1,2})[./-]", r"(?!\d)"
    numeric = F.regexp_replace(text, rf"{day}{month}(69|[789]\d){rest}", "$1/$2/19$3")
    numeric = F.regexp_replace(numeric, rf"{day}{month}(\d{{2}}){rest}", "$1/$2/20$3")
    numeric = F.regexp_replace(numeric, rf"{day}{month}(\d{{4}})", "$1/$2/$3")
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp")),
        F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")).try_cast("timestamp")),
        F.try_to_timestamp(numeric, F.lit("d/M/yyyy")),
        F.try_to_timestamp(numeric, F.lit("d/M/yyyy HH:mm")),
        F.try_to_timestamp(numeric, F.lit("d/M/yyyy HH:mm:ss")),
        F.try_to_timestamp(F.initcap(named), F.lit("d MMM yyyy")),
    )

"""Date functions on time-zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def date_span(start: Column, end: Column) -> Column:
    """Days from start to end, both included; empty if end is earlier."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def each_day(start: Column, end: Column) -> Column:
    """Days from start up to, but without, end."""
    return date_span(start, F.date_sub(end, 1))


def next_weekday(day: Column, name: str) -> Column:
    return F.next_day(day, name[:3])


def last_weekday(day: Column, name: str) -> Column:
    return F.next_day(F.date_sub(day, 8), name[:3])


def named(names: list[str], prefix: Column) -> Column:
    """1-based place of the first name that begins with prefix; null if none does."""
    hit = F.array_position(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: n.startswith(F.lower(prefix)) & (prefix != "")), True)
    return F.nullif(hit, F.lit(0).cast("long"))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def magic_date(text: Column, today: Column, compat: bool = False) -> Column:
    """A date from free text, seen from `today`; null if no pattern fits. The first of these wins:

    -2 weeks 3 days (days from hours on round down), 3 days ago, today, now, tomorrow,
    yesterday, 4th, 4th Jan [2003], Jan 4th[, 2003], m/d/Y, d/m/Y, Y-m-d, YYYYmmdd[HHMMSS],
    next <weekday>, [last] <weekday>. compat: hours and smaller units of the first are ignored.
    """
    t = F.lower(F.trim(text))
    unit = lambda p: F.coalesce(_number(t, r"(\d+)\s*" + p, 1), F.lit(0))
    back = unit("w") * 7 + unit("d") if compat else unit("w") * 7 + unit("d") + F.floor(unit("h") / 24).cast("int")
    month_name, day_name = "(" + "|".join(f"{m[:3]}[a-z]*" for m in MONTHS) + ")", "(" + "|".join(f"{d[:3]}[a-z]*" for d in DAYS) + ")"
    this_year, this_month = F.year(today), F.month(today)
    day_first, month_first = rf"^(\d{{1,2}})(?:st|nd|rd|th)?\s+{month_name}(?:,?\s+(\d{{4}}))?$", rf"^{month_name}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?$"
    made = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    in_month = lambda p, g: named(MONTHS, F.regexp_extract(t, p, g)).cast("int")
    in_year = lambda p, g: F.coalesce(_number(t, p, g), this_year)
    slashes, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    a, b, y = (_number(t, slashes, n) for n in (1, 2, 3))
    weekday = named(DAYS, F.regexp_extract(t, rf"^(?:next\s+|last\s+)?{day_name}$", 1))
    ahead = lambda base: F.coalesce(*[F.when(weekday == n + 1, F.next_day(base, d[:3])) for n, d in enumerate(DAYS)])
    return (
        F.when(t.startswith("-"), F.date_sub(today, back))
        .when(t.rlike(r"\bago$"), F.date_sub(today, back))
        .when(t.startswith("tod") | t.startswith("now"), today)
        .when(t.startswith("tom"), F.date_add(today, 1))
        .when(t.startswith("yes"), F.date_sub(today, 1))
        .when(t.rlike(r"^\d{1,2}(st|nd|rd|th)?$"), made(this_year, this_month, _number(t, r"^(\d{1,2})", 1)))
        .when(t.rlike(day_first), made(in_year(day_first, 3), in_month(day_first, 2), _number(t, day_first, 1)))
        .when(t.rlike(month_first), made(in_year(month_first, 3), in_month(month_first, 1), _number(t, month_first, 2)))
        .when(t.rlike(slashes), F.coalesce(made(y, a, b), made(y, b, a)))
        .when(t.rlike(iso), made(*[_number(t, iso, n) for n in (1, 2, 3)]))
        .when(t.rlike(r"^\d{8}(\d{6})?$"), F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd"))
        .when(t.rlike(rf"^next\s+{day_name}$"), ahead(today))
        .when(t.rlike(rf"^(last\s+)?{day_name}$"), ahead(F.date_sub(today, 8)))
    )


def magic_time(text: Column, now: Column) -> Column:
    """magic_date() with the time of day where the text tells one: so long ago to the second, now, YYYYmmddHHMMSS; else midnight. now: a timestamp without zone."""
    t = F.lower(F.trim(text))
    unit = lambda p: F.coalesce(_number(t, rf"(\d+)\s*{p}", 1), F.lit(0))
    seconds = unit("w") * 604800 + unit("d") * 86400 + unit("h") * 3600 + unit("m") * 60 + unit("s")
    ago = t.startswith("-") | t.rlike(r"\bago$")
    digits = F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    back = now - F.make_dt_interval(secs=seconds)
    return F.when(ago, back).when(t.startswith("now"), now).when(t.rlike(r"^\d{14}$"), digits).otherwise(magic_date(text, F.to_date(now)).cast("timestamp_ntz"))


def flag_date(text: Column, today: Column) -> Column:
    """Digits that are an epoch between 1991 and 2049, else magic_date."""
    epoch = F.timestamp_seconds(F.when(F.length(text) <= 11, text.try_cast("bigint")))
    return F.when(text.rlike("^[0-9]+$") & F.year(epoch).between(1991, 2049), F.to_date(epoch)).otherwise(magic_date(text, today))

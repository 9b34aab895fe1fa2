"""Calendar bins and date snapping as plain column expressions.

Period-end rules (``W-*``, ``M``, ``Q``, ``A``) label a bin with its last day;
period-start rules (``D``, ``B``, ``MS``, ``QS``, ``AS``) with its first day.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
ALIASES = {"W": "W-SUN", "ME": "M", "QE": "Q", "YE": "A", "YS": "AS", "Y": "A"}
RULES = ("D", "B", *(f"W-{d}" for d in WEEKDAYS), "MS", "M", "QS", "Q", "AS", "A")


def canonical_rule(rule: str) -> str:
    r = ALIASES.get(rule.upper(), rule.upper())
    if r not in RULES:
        raise ValueError(f"unknown calendar rule {rule!r}; expected one of {RULES}")
    return r


def bin_label(ts: Column, rule: str) -> Column:
    """The label of the bin of ``rule`` that holds ``ts``."""
    r, d = canonical_rule(rule), ts.cast("date")
    if r == "D":
        return d
    if r == "B":  # weekends belong to the Friday that opens the bin
        return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))
    if r.startswith("W-"):
        return F.date_add(d, F.pmod(F.lit(WEEKDAYS.index(r[2:])) - F.weekday(d), F.lit(7)))
    if r == "MS":
        return F.trunc(d, "MM").cast("date")
    if r == "M":
        return F.last_day(d)
    if r == "QS":
        return F.trunc(d, "QUARTER").cast("date")
    if r == "Q":
        return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))
    if r == "AS":
        return F.trunc(d, "YEAR").cast("date")
    return F.make_date(F.year(d), F.lit(12), F.lit(31))


def bin_next(label: Column, rule: str, n: int = 1) -> Column:
    """The label ``n`` bins after (before, when negative) ``label``."""
    r = canonical_rule(rule)
    if r == "D":
        return F.date_add(label, n)
    if r == "B":  # whole weeks, then the rest skips the weekend
        weeks, rest = divmod(n, 5)
        hop = F.when(F.weekday(label) + rest > 4, F.lit(rest + 2)).otherwise(F.lit(rest))
        return F.date_add(label, hop + F.lit(7 * weeks))
    if r.startswith("W-"):
        return F.date_add(label, 7 * n)
    months = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "A": 12, "AS": 12}[r] * n
    moved = F.add_months(F.trunc(label, "MM"), months)
    return F.last_day(moved) if r in ("M", "Q", "A") else moved.cast("date")


def bin_sequence(lo: Column, hi: Column, rule: str) -> Column:
    """Array of all labels from label ``lo`` to label ``hi``."""
    r = canonical_rule(rule)
    if r == "D":
        return F.sequence(lo, hi, F.expr("interval 1 day"))
    if r == "B":
        return F.filter(F.sequence(lo, hi, F.expr("interval 1 day")), lambda x: F.weekday(x) < 5)
    if r.startswith("W-"):
        return F.sequence(lo, hi, F.expr("interval 7 day"))
    step = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "A": 12, "AS": 12}[r]
    first = F.sequence(F.trunc(lo, "MM").cast("date"), F.trunc(hi, "MM").cast("date"),
                       F.expr(f"interval {step} month"))
    return F.transform(first, lambda x: F.last_day(x)) if r in ("M", "Q", "A") else first


def bin_ordinal(label: Column, rule: str) -> Column:
    """A running bin number, so that positions are arithmetic and need no scan."""
    r = canonical_rule(rule)
    days = F.datediff(label, F.lit("1970-01-05").cast("date"))  # a Monday
    if r == "D":
        return days
    if r == "B":
        return (F.floor(days / F.lit(7)) * 5 + F.weekday(label)).cast("int")
    if r.startswith("W-"):
        return F.floor(days / F.lit(7)).cast("int")
    months = F.year(label) * 12 + F.month(label) - 1
    step = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "A": 12, "AS": 12}[r]
    return F.floor(months / F.lit(step)).cast("int")


def nearest_friday(ts: Column) -> Column:
    """Friday of the same Monday-to-Sunday week."""
    return F.date_add(ts, F.lit(4) - F.weekday(ts))


def month_last_friday(ts: Column) -> Column:
    end = F.last_day(ts)
    return F.date_sub(end, F.pmod(F.weekday(end) + 3, F.lit(7)))


def snap_weekday(ts: Column, weekday: int) -> Column:
    """Weekday (0=Monday) of the same Monday-to-Sunday week."""
    return F.date_add(ts, F.lit(weekday) - F.weekday(ts))


def snap_month_day(ts: Column, day: int | None) -> Column:
    """Day of the same month, clamped to its length; None means the last day."""
    end = F.last_day(ts)
    if day is None:
        return end
    return F.date_add(F.trunc(ts, "MM").cast("date"), F.least(F.lit(day), F.dayofmonth(end)) - 1)


def to_business_day(ts: Column, forward: bool) -> Column:
    """Move weekend dates to the next (forward) or previous business day."""
    wd = F.weekday(ts)
    moved = F.date_add(ts, F.lit(7) - wd) if forward else F.date_sub(ts, wd - 4)
    return F.when(wd >= 5, moved).otherwise(ts)


def friday_of_iso_week(year: Column, week: Column) -> Column:
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(jan4, F.weekday(jan4))
    return F.date_add(monday, (week - 1) * 7 + 4)


def sunday_week(ts: Column) -> Column:
    """Week of the year with Sunday as first day; days before the first Sunday are week 0."""
    return F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) - 1)) / F.lit(7)).cast("int")


def period_label(ts: Column, freq: str) -> Column:
    """Text label of the year, month, quarter or Sunday week that holds ``ts``."""
    y = F.year(ts).cast("string")
    if freq == "year":
        return y
    if freq == "month":
        return F.date_format(ts, "MM")
    if freq == "quarter":
        return F.concat(y, F.lit("-Q"), F.quarter(ts).cast("string"))
    if freq == "week":
        return F.concat(y, F.lit("-W"), F.lpad(sunday_week(ts).cast("string"), 2, "0"))
    raise ValueError(f"unknown period {freq!r}")

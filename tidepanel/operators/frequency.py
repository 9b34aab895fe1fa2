"""Frequency inference, resampling, alignment and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.calendar import (
    WEEKDAYS, bin_label, bin_sequence, month_last_friday, nearest_friday,
    snap_month_day, snap_weekday, to_business_day,
)
from tidepanel.operators.panel import SERIES, densify, panel_bounds, series_window
from tidepanel.operators.quantile import exact_quantile

# ---------------------------------------------------------------- inference

MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def gap_stats(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Everything inference needs about the gaps of each series: one window and
    one aggregate on the same exchange."""
    w = series_window(keys)
    prev = F.lag("ts").over(w)
    mon = F.year("ts") * 12 + F.month("ts")
    d = df.filter(F.col("value").isNotNull()).select(*keys, "ts").distinct()
    d = d.withColumns({"gap": F.datediff("ts", prev), "mgap": mon - F.lag(mon).over(w),
                       "wd": F.weekday("ts"), "pwd": F.weekday(prev)})
    share = lambda cond: F.avg(F.when(F.col("gap").isNotNull(), cond.cast("int")))
    business = (F.col("wd") < 5) & F.coalesce(F.col("gap") == F.when(F.col("pwd") == 4, 3).otherwise(1), F.lit(True))
    per_weekday = [F.struct(F.count_if(F.col("wd") == i).alias("n"), F.lit(-i).alias("i")) for i in range(7)]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"),
        F.min("mgap").alias("min_mgap"), F.max("mgap").alias("max_mgap"),
        F.bool_and(F.col("ts") == F.last_day("ts")).alias("all_month_end"),
        F.bool_and(F.dayofmonth("ts") == 1).alias("all_month_start"),
        F.avg((F.col("ts") == F.last_day("ts")).cast("int")).alias("month_end_share"),
        F.avg((F.dayofmonth("ts") == 1).cast("int")).alias("month_start_share"),
        F.bool_and(business).alias("all_business"),
        share(F.col("gap") == 1).alias("daily_share"), share(F.col("gap").isin(1, 3)).alias("business_share"),
        share(F.col("gap").between(6, 8)).alias("weekly_share"),
        share(F.col("gap").between(27, 32)).alias("monthly_share"),
        (-F.greatest(*per_weekday).getField("i")).alias("modal_weekday"),
        F.weekday(F.max("ts")).alias("last_weekday"), F.month(F.max("ts")).alias("last_month"))


def _pick(names: Sequence[str], i: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int")))


def regular_code(month_end: str = "M") -> Column:
    """Code of an exactly regular series, else NULL; needs three stamps."""
    n = F.col("min_mgap")
    same_month_step = (n == F.col("max_mgap")) & (n > 0)
    count = lambda k: F.when(n / F.lit(k) > 1, F.floor(n / F.lit(k)).cast("string")).otherwise(F.lit(""))
    quarter_anchor = F.element_at(F.array(*[F.lit(x) for x in ("DEC", "OCT", "NOV")]), (F.col("last_month") % 3 + 1).cast("int"))

    def period(year_code, quarter_code, month_code):
        return (F.when(n % 12 == 0, F.concat(count(12), _pick(MONTHS, F.col("last_month") - 1, f"{year_code}-")))
                .when(n % 3 == 0, F.concat(count(3), F.lit(f"{quarter_code}-"), quarter_anchor))
                .otherwise(F.concat(count(1), F.lit(month_code))))
    gap = F.col("min_gap")
    days = F.when(gap % 7 == 0, F.concat(F.when(gap > 7, (gap / 7).cast("int").cast("string")).otherwise(F.lit("")),
                                         _pick(WEEKDAYS, F.col("last_weekday"), "W-")))
    days = days.otherwise(F.concat(F.when(gap > 1, gap.cast("string")).otherwise(F.lit("")), F.lit("D")))
    return (F.when(F.col("n") < 3, None)
            .when(same_month_step & F.col("all_month_end"), period("A", "Q", month_end))
            .when(same_month_step & F.col("all_month_start"), period("AS", "QS", "MS"))
            .when(gap == F.col("max_gap"), days)
            .when(F.col("all_business"), F.lit("B")))


def infer_frequency(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Frequency group and code per series from its own non-missing stamps."""
    d = gap_stats(df, keys).withColumn("code", regular_code())
    code = F.col("code")
    is_code = lambda *prefixes: F.coalesce(code.rlike(r"^\d*(" + "|".join(prefixes) + r")(-|$)"), F.lit(False))
    week_code = F.when(is_code("W"), code).otherwise(_pick(WEEKDAYS, F.col("modal_weekday"), "W-"))
    month_code = (F.when(is_code("M", "MS"), code).when(F.col("month_start_share") > 0.6, "MS")
                  .when(F.col("month_end_share") > 0.6, "ME").otherwise("M"))
    rules = [
        (F.col("n") < 2, "Undetermined", F.lit(None).cast("string")),
        (is_code("A", "AS"), "Annual", code),
        (is_code("Q", "QS"), "Quarterly", code),
        (is_code("M", "MS") & ((F.col("monthly_share") > 0.6) | (F.col("n") < 10)), "Monthly", code),
        (is_code("W") & ((F.col("weekly_share") > 0.6) | (F.col("n") < 20)), "Weekly", code),
        (F.col("weekly_share") > 0.8, "Weekly", week_code),
        (F.col("monthly_share") > 0.8, "Monthly", month_code),
        (is_code("B") & ((F.col("business_share") > 0.6) | (F.col("daily_share") > 0.6)), "Business Daily", code),
        (is_code("D") & (F.col("weekly_share") < 0.5) & (F.col("monthly_share") < 0.5), "Daily", code),
        ((F.col("daily_share") > 0.6) & (F.col("max_gap") < 6) & (F.col("weekly_share") < 0.6), "Daily", F.lit("D")),
        (code.isNotNull(), "Specific", code),
    ]
    group, out_code = F.lit("Irregular"), F.lit(None).cast("string")
    for cond, g, c in reversed(rules):
        group = F.when(cond, g).otherwise(group)
        out_code = F.when(cond, c).otherwise(out_code)
    return d.select(*keys, "n", "first_ts", "last_ts", group.alias("freq_group"), out_code.alias("freq_code"))


def series_time_info(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Start, end and a code that falls back to the typical gap."""
    d = gap_stats(df, keys).withColumn("code", regular_code())
    fallback = (F.when(F.col("n") < 2, None).when(F.col("all_month_end"), "ME")
                .when(F.col("median_gap").between(6, 8), "W-MON")
                .when(F.col("median_gap").between(28, 32),
                      F.when(F.col("month_start_share") > 0.7, "MS").otherwise("ME")))
    return d.select(*keys, F.col("first_ts").alias("start"), F.col("last_ts").alias("end"),
                    F.coalesce("code", fallback).alias("freq_code"))


def infer_panel_frequency(inferred: DataFrame) -> DataFrame:
    """Group held by more than half of the classified series and its commonest code."""
    ok = inferred.filter(~F.col("freq_group").isin("Undetermined", "Irregular"))
    codes = (ok.groupBy("freq_group", "freq_code").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("freq_group").agg(F.sum("n").alias("n"),
                                        F.max_by("freq_code", F.struct("n", "freq_code")).alias("freq_code")))
    top = codes.agg(F.sum("n").alias("total"), F.max(F.struct("n", "freq_group", "freq_code")).alias("t"))
    major = F.col("t.n") * 2 > F.col("total")
    return top.select(F.when(F.col("total").isNull(), "Undetermined").when(major, F.col("t.freq_group"))
                      .otherwise("Mixed/Irregular").alias("freq_group"),
                      F.when(major, F.col("t.freq_code")).alias("freq_code"),
                      F.coalesce("total", F.lit(0)).alias("n_series"))


def gap_profile(df: DataFrame, top: int = 3, keys: Sequence[str] = SERIES) -> DataFrame:
    """Most common gaps between stamps, with counts; the counting is an aggregate,
    only the small (gap, count) table is ordered."""
    gaps = _gaps(df, keys).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return gaps.orderBy(F.col("n").desc(), "gap").limit(top)


def median_gap(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Median gap in days over all series."""
    gaps = _gaps(df, keys).select(F.col("gap").cast("double").alias("value"))
    return exact_quantile(gaps, [], name="median_gap")


def _gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = df.select(*keys, "ts").distinct()
    return d.select(*keys, F.datediff("ts", F.lag("ts").over(series_window(keys))).alias("gap")).filter("gap is not null")


def robust_infer(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Exact code, else a label of the modal gap and how dominant it is."""
    per_gap = _gaps(df, keys).groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    modal = per_gap.groupBy(*keys).agg(F.sum("n").alias("total"),
                                       F.max(F.struct("n", (-F.col("gap")).alias("neg"))).alias("m"))
    gap, share = -F.col("m.neg"), F.try_divide(F.col("m.n"), F.col("total"))
    label = (F.when(gap == 1, "daily").when(gap == 7, "weekly").when(gap.between(28, 31), "monthly")
             .when(gap.between(89, 92), "quarterly").when(gap.between(360, 370), "annual"))
    text = (F.when(label.isNotNull() & (share > 0.5), F.concat(label, F.lit(" (dominant)")))
            .when(label.isNotNull(), F.concat(label, F.lit(" (most common: "), gap.cast("string"), F.lit(" days)")))
            .when(share > 0.3, F.concat(F.lit("main interval: "), gap.cast("string"), F.lit(" days")))
            .otherwise("irregular or mixed"))
    exact = gap_stats(df, keys).select(*keys, "n", regular_code().alias("code"))
    return exact.join(modal, list(keys), "left").select(
        *keys, F.coalesce("code", F.when(F.col("n") >= 2, text), F.lit("not enough points")).alias("frequency"))


# ---------------------------------------------------------------- resampling

def _bin_agg(agg: str) -> Column:
    v, t = F.col("value"), F.col("ts")
    known = F.when(v.isNotNull(), t)
    if agg == "last":
        return F.max_by(v, known)
    if agg == "first":
        return F.min_by(v, known)
    return {"mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg](v)


def resample(df: DataFrame, rule: str, agg: str = "last", dense: bool = True, start=None, end=None,
             keys: Sequence[str] = SERIES) -> DataFrame:
    """One value per series and bin of ``rule``; empty bins between the panel's
    bounds are NULL (0 for sum and count). First and last skip missing values.

    The bin aggregate combines map-side before the shuffle. Text values take
    first, last, min, max and count."""
    out = _binned(df, rule, agg, keys)
    if dense:
        lo, hi = panel_bounds(df, start, end)
        out = densify(out, rule, keys, "panel", bin_label(lo, rule), bin_label(hi, rule))
    if agg in ("sum", "count"):
        out = out.withColumn("value", F.coalesce("value", F.lit(0.0 if agg == "sum" else 0)))
    return out


def _binned(df: DataFrame, rule: str, agg: str, keys: Sequence[str]) -> DataFrame:
    label = bin_label(F.col("ts"), rule)
    if agg == "median":  # raw bins may be huge
        d = df.withColumn("_bin", label)
        out = exact_quantile(d, [*keys, "_bin"], name="value")
        empty = d.groupBy(*keys, "_bin").agg(F.count("value").alias("_n")).filter("_n = 0")
        out = out.unionByName(empty.select(*keys, "_bin", F.lit(None).cast("double").alias("value")))
        return out.select(*keys, F.col("_bin").alias("ts"), "value")
    return df.withColumn("_bin", label).groupBy(*keys, "_bin").agg(_bin_agg(agg).alias("value")) \
             .select(*keys, F.col("_bin").alias("ts"), "value")


def to_weekly_friday(df: DataFrame, native: str = "weekly", **kw) -> DataFrame:
    """Weekly series take the last value of the week, daily ones the mean."""
    return resample(df, "W-FRI", "last" if native == "weekly" else "mean", **kw)


def to_daily(df: DataFrame, numeric: bool = True, **kw) -> DataFrame:
    return resample(df, "D", "mean" if numeric else "first", **kw)


def align_to_period(df: DataFrame, freq: str, edge: str = "last", business: bool = False,
                    keys: Sequence[str] = SERIES) -> DataFrame:
    """First or last value per week, month, quarter or year, labelled with that
    day; weekend labels move to a business day; dates without any value go.

    "First of week" bins close on the Monday they are labelled with."""
    rules = {"week": ("W-MON", "W-SUN"), "month": ("MS", "M"), "quarter": ("QS", "Q"), "year": ("AS", "A")}
    d = df.filter(F.col("value").isNotNull())
    if freq != "day":
        d = _binned(d, rules[freq][0 if edge == "first" else 1], edge, keys)
    if business:
        d = d.withColumn("_from", F.col("ts")).withColumn("ts", to_business_day(F.col("ts"), edge == "first"))
        pick = F.min_by if edge == "first" else F.max_by
        d = d.groupBy(*keys, "ts").agg(pick("value", "_from").alias("value"))
    return d.select(*keys, "ts", "value")


def asfreq(df: DataFrame, rule: str, keys: Sequence[str] = SERIES, start=None, end=None) -> DataFrame:
    """Keep only values that sit exactly on the labels of ``rule``, on a dense calendar."""
    on_label = df.filter(F.col("ts") == bin_label(F.col("ts"), rule))
    marked = df.select(*keys, bin_label(F.col("ts"), rule).alias("ts"), F.lit(None).cast("double").alias("value"))
    both = on_label.select(*keys, "ts", "value").unionByName(marked).groupBy(*keys, "ts").agg(F.max("value").alias("value"))
    lo, hi = panel_bounds(df, start, end)
    return densify(both, rule, keys, "panel", bin_label(lo, rule), bin_label(hi, rule))


FREQ_LEVELS = {"D": 0, "B": 0, "W": 1, "M": 2, "Q": 3, "A": 4}


def _level(rule: str) -> int:
    return FREQ_LEVELS[rule.upper().split("-")[0][0]]


def value_align(df: DataFrame, rule: str, keys: Sequence[str] = SERIES, start=None, end=None) -> DataFrame:
    """High to low frequency keeping original values, lending one to an empty
    neighbour.

    A bin with two or more values gives its first one to an empty bin before it.
    Then a single value stays; of several the last is taken when the bin before
    ended filled, else the first. Whether a bin was lent to or filled follows
    from the counts of its neighbours, so windows suffice. ``event`` tells how
    each value came about.
    """
    v, t = F.col("value"), F.col("ts")
    d = df.filter(v.isNotNull()).withColumn("_bin", bin_label(t, rule))
    bins = d.groupBy(*keys, "_bin").agg(F.struct(F.count(v).alias("n"), F.min_by(v, t).alias("first"),
                                                 F.max_by(v, t).alias("last")).alias("value"))
    bins = bins.select(*keys, F.col("_bin").alias("ts"), "value")
    lo, hi = panel_bounds(df, start, end)
    full = densify(bins, rule, keys, "panel", bin_label(lo, rule), bin_label(hi, rule))
    full = full.select(*keys, "ts", F.coalesce("value.n", F.lit(0)).alias("n"),
                       F.col("value.first").alias("first"), F.col("value.last").alias("last"))
    w = series_window(keys)
    lent = (F.col("n") == 0) & F.coalesce(F.lead("n").over(w) >= 2, F.lit(False))
    full = full.withColumns({"lent": lent, "lent_value": F.lead("first").over(w)})
    filled_before = F.coalesce((F.lag("n").over(w) > 0) | F.lag("lent").over(w), F.lit(False))
    full = full.withColumn("after_filled", filled_before)
    value = (F.when(F.col("lent"), F.col("lent_value")).when(F.col("n") == 1, F.col("first"))
             .when((F.col("n") >= 2) & F.col("after_filled"), F.col("last"))
             .when(F.col("n") >= 2, F.col("first")))
    event = (F.when(F.col("lent"), "lent_by_next").when(F.col("n") == 1, "single")
             .when((F.col("n") >= 2) & F.col("after_filled"), "last_of_several")
             .when(F.col("n") >= 2, "first_of_several"))
    return full.select(*keys, "ts", value.alias("value"), event.alias("event"), "n")


def align_frequency(df: DataFrame, base_rule: str, target_rule: str, mode: str = "stat_align",
                    agg: str = "last", complete: bool = False, keys: Sequence[str] = SERIES):
    """(aligned, report). Value mode needs a step of one level down; towards the
    same or a higher frequency values stay on exact stamps only."""
    step = _level(target_rule) - _level(base_rule)
    if mode == "value_align" and step >= 2:
        mode = "stat_align"
    if mode == "stat_align" and step > 0:
        out = resample(df, target_rule, agg, keys=keys)
    elif mode == "value_align" and step > 0:
        out = value_align(df, target_rule, keys).select(*keys, "ts", "value")
    else:
        out = asfreq(df, target_rule, keys)
    if complete:
        out = complete_index(out, target_rule, keys)
    before = df.groupBy(*keys).agg(F.count("value").alias("n_before"))
    after = out.groupBy(*keys).agg(F.count("value").alias("n_after"))
    return out, before.join(after, list(keys), "full_outer")


def snap_dates(df: DataFrame, freq: str, day: int | None, how: str = "last", keys: Sequence[str] = SERIES) -> DataFrame:
    """Weekly: move to weekday ``day`` (0=Monday) of the same week; monthly: to
    day ``day`` (clamped), None = last day. Collisions resolve by ``how``."""
    to = snap_weekday(F.col("ts"), day) if freq == "week" else snap_month_day(F.col("ts"), day)
    if how == "median":
        return exact_quantile(df.withColumn("_to", to), [*keys, "_to"], name="value").withColumnRenamed("_to", "ts")
    return (df.withColumn("_to", to).groupBy(*keys, "_to").agg(_bin_agg(how).alias("value"))
            .select(*keys, F.col("_to").alias("ts"), "value"))


def complete_index(df: DataFrame, rule: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Every label between the first and last stamp; the first value per bin stays."""
    return resample(df, rule, "first", keys=keys)


# ---------------------------------------------------------------- Friday calendars

def align_nearest_friday(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Publication dates to the Friday of their week; the last non-missing wins."""
    return (df.withColumn("_f", nearest_friday(F.col("ts"))).groupBy(*keys, "_f")
            .agg(_bin_agg("last").alias("value")).select(*keys, F.col("_f").alias("ts"), "value"))


def align_month_last_friday(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return (df.withColumn("_f", month_last_friday(F.col("ts"))).groupBy(*keys, "_f")
            .agg(_bin_agg("last").alias("value")).select(*keys, F.col("_f").alias("ts"), "value"))


def _friday_on_or_before(c: Column) -> Column:
    return F.date_sub(c, F.pmod(F.weekday(c) - 4, F.lit(7)))


def target_bounds(lo: Column, hi: Column, start=None, end=None) -> tuple[Column, Column]:
    """First and last Friday of the common calendar for data from ``lo`` to ``hi``."""
    s = F.lit(start).cast("date") if start is not None else lo
    e = F.lit(end).cast("date") if end is not None else hi
    hi_fri = F.date_add(hi, F.pmod(F.lit(4) - F.weekday(hi), F.lit(7)))
    return (F.greatest(_friday_on_or_before(lo), _friday_on_or_before(s)),
            F.least(hi_fri, _friday_on_or_before(e)))


def target_calendar(df: DataFrame, start=None, end=None) -> DataFrame:
    """Fridays common to the data and the wanted range."""
    span = df.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    a, z = target_bounds(F.col("lo"), F.col("hi"), start, end)
    return span.filter(a <= z).select(F.explode(bin_sequence(a, z, "W-FRI")).alias("ts"))

"""Growth summaries, industry roll-ups, diffusion, seasonal bands and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.calendar import bin_label, bin_next, period_label
from tidepanel.functions.scalars import safe_div
from tidepanel.operators.panel import SERIES, lag_at, panel_bounds, running_back, with_position
from tidepanel.operators.quantile import exact_quantile

WEEKLY_OFFSETS = {"w1": 7, "w4": 28, "w52": 364}
DAILY_OFFSETS = {"d1": 1, "d7": 7, "d30": 30, "d365": 365}
# Rows a year-on-year or period-on-period change looks back.
CHANGE_PERIODS = {
    "daily": {"yoy": 365, "pop": 1},
    "weekly": {"yoy": 52, "pop": 1},
    "monthly": {"yoy": 12, "pop": 1},
    "annual": {"yoy": 1, "pop": 1},
}
HEATMAP_PERIODS = {"daily": 20, "weekly": 15, "monthly": 12, "annual": 5}
CALENDAR_OF = {"daily": "D", "weekly": "W-FRI", "monthly": "M", "annual": "A"}


def _with_last(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach each series' own last stamp. Window and the following aggregate
    share one exchange on the series."""
    live = df.filter(F.col("value").isNotNull())
    return live.withColumn("last_ts", F.max("ts").over(Window.partitionBy(*keys)))


def _band(value: Column, inside: Column) -> list[Column]:
    v = F.when(inside, value)
    return [F.max(v).alias("max_5y"), F.min(v).alias("min_5y"), F.avg(v).alias("mean_5y")]


def _prior_five_years() -> Column:
    return F.year("ts").between(F.year("last_ts") - 5, F.year("last_ts") - 1)


def growth_summary(df: DataFrame, offsets: Mapping[str, int], keys: Sequence[str] = SERIES) -> DataFrame:
    """Per series at its own last date: values the given days earlier, growth
    against them, and the range of the five calendar years before."""
    at = {name: F.max(F.when(F.col("ts") == F.date_sub("last_ts", days), F.col("value")))
          for name, days in offsets.items()}
    out = _with_last(df, keys).groupBy(*keys).agg(
        F.max("last_ts").alias("last_ts"),
        F.max(F.when(F.col("ts") == F.col("last_ts"), F.col("value"))).alias("last_value"),
        *[c.alias(f"value_{n}") for n, c in at.items()],
        *_band(F.col("value"), _prior_five_years()))
    return out.withColumns({
        f"growth_{n}": safe_div(F.col("last_value") - F.col(f"value_{n}"), F.abs(f"value_{n}"))
        for n in offsets})


def weekly_growth_summary(df, keys=SERIES) -> DataFrame:
    return growth_summary(df, WEEKLY_OFFSETS, keys)


def daily_growth_summary(df, keys=SERIES) -> DataFrame:
    return growth_summary(df, DAILY_OFFSETS, keys)


def monthly_growth_summary(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Against the previous calendar month and the same month a year earlier
    (the last value in it), as differences."""
    mon = lambda c: F.year(c) * 12 + F.month(c)
    d = _with_last(df, keys).withColumn("_back", mon("last_ts") - mon("ts"))

    def last_in(back):
        return F.max_by(F.when(F.col("_back") == back, F.col("value")),
                        F.when(F.col("_back") == back, F.col("ts")))
    out = d.groupBy(*keys).agg(
        F.date_format(F.max("last_ts"), "yyyy-MM").alias("last_month"),
        F.max_by("value", "ts").alias("last_value"),
        last_in(1).alias("value_m1"), last_in(12).alias("value_m12"),
        *_band(F.col("value"), _prior_five_years()))
    return out.withColumns({f"growth_{n}": F.col("last_value") - F.col(f"value_{n}") for n in ("m1", "m12")})


def weekly_report(df: DataFrame, reporting_date=None, keys: Sequence[str] = SERIES) -> DataFrame:
    """One fixed reporting date (the panel's last date when it is None or not in
    the data); year-ago value falls back to the latest one before it."""
    live = df.filter(F.col("value").isNotNull())
    if reporting_date is None:
        report = panel_bounds(df)[1]
    else:
        want = F.lit(reporting_date).cast("date")
        report = df.agg(F.coalesce(F.max(F.when(F.col("ts") == want, F.col("ts"))), F.max("ts"))).scalar()
    d = live.select("*", report.alias("report_ts"))
    at = lambda c: F.max(F.when(F.col("ts") == c, F.col("value")))
    year_ago = F.date_sub("report_ts", 364)
    before = F.when(F.col("ts") <= year_ago, F.col("ts"))
    span = F.col("ts").between(F.date_sub("report_ts", 365 * 5), F.col("report_ts"))
    out = d.groupBy(*keys).agg(
        F.max("report_ts").alias("report_ts"), at(F.col("report_ts")).alias("last_value"),
        at(F.date_sub("report_ts", 7)).alias("value_w1"),
        F.max_by(F.when(before.isNotNull(), F.col("value")), before).alias("value_w52"),
        *_band(F.col("value"), span))
    return out.withColumns({
        "growth_w1": safe_div(F.col("last_value"), F.col("value_w1")) - 1,
        "growth_w52": safe_div(F.col("last_value"), F.col("value_w52")) - 1})


def industry_overview(summary: DataFrame, dim: DataFrame, growth_cols: Sequence[str],
                      default: str = "未分类", total: str = "合计") -> DataFrame:
    """Per industry and in total: how many series grow and how many lie outside
    or on either side of their five-year range, with shares."""
    d = summary.join(dim.select("series", "industry"), "series", "left")
    d = d.withColumn("industry", F.coalesce("industry", F.lit(default)))
    counts = {f"up_{c.removeprefix('growth_')}": F.count_if(F.col(c) > 0) for c in growth_cols}
    counts |= {
        "above_max": F.count_if(F.col("last_value") > F.col("max_5y")),
        "below_min": F.count_if(F.col("last_value") < F.col("min_5y")),
        "above_mean": F.count_if(F.col("last_value") > F.col("mean_5y")),
        "below_mean": F.count_if(F.col("last_value") < F.col("mean_5y")),
    }
    out = (d.rollup("industry")
           .agg(F.grouping("industry").alias("_total"), F.count(F.lit(1)).alias("n_series"),
                *[c.alias(n) for n, c in counts.items()])
           .withColumn("industry", F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col("industry"))))
    shares = [safe_div(F.col(n) * 100.0, F.col("n_series")).alias(f"{n}_pct") for n in counts]
    return out.select("industry", "n_series", *counts, *shares)


def industry_summary_table(summary: DataFrame, dim: DataFrame, industry: str, by: str) -> DataFrame:
    """One industry's summary rows, fastest growing first."""
    mine = dim.filter(F.col("industry") == industry).select("series")
    return summary.join(mine, "series", "left_semi").orderBy(F.col(by).desc_nulls_last(), "series")


def rank_by_latest_change(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Series ordered by the change between their own last two points; a zero
    base ranks first, a single point counts as no change."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    two = (df.filter(F.col("value").isNotNull()).withColumn("_rn", F.row_number().over(w))
           .filter(F.col("_rn") <= 2))
    pick = lambda i: F.max(F.when(F.col("_rn") == i, F.col("value")))
    out = two.groupBy(*keys).agg(pick(1).alias("latest"), pick(2).alias("previous"))
    change = (F.when(F.col("previous").isNull(), F.lit(0.0))
              .when(F.col("previous") == 0, F.lit(float("inf")))
              .otherwise(safe_div(F.col("latest") - F.col("previous"), F.col("previous"))))
    return out.withColumn("change", change).orderBy(F.col("change").desc(), *keys)


def pct_change(df: DataFrame, n: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Percent change against the value ``n`` panel positions earlier; needs ``pos``."""
    prev = lag_at("value", n, keys)
    return df.withColumn("pct", (safe_div(F.col("value"), prev) - 1) * 100)


def base_period_range(df: DataFrame, freq: str, kind: str, start=None, end=None) -> DataFrame:
    """Rows from ``n`` periods before ``start`` to ``end``: what a lagged change
    shown from ``start`` needs. The filter reaches the scan, which Catalyst
    would not do through a window."""
    if start is not None:
        lo = bin_next(F.lit(start).cast("date"), CALENDAR_OF[freq], -CHANGE_PERIODS[freq][kind])
        df = df.filter(F.col("ts") >= lo)
    return df if end is None else df.filter(F.col("ts") <= F.lit(end).cast("date"))


def diffusion_index(df: DataFrame, freq: str = "weekly", kind: str = "yoy", threshold: float = 0.0,
                    start=None, end=None, keys: Sequence[str] = SERIES, rule: str | None = None) -> DataFrame:
    """Share of series (in percent) whose change exceeds ``threshold`` per date."""
    n = CHANGE_PERIODS[freq][kind]
    rows = with_position(base_period_range(df, freq, kind, start, end), rule)
    d = pct_change(rows, n, keys)
    if start is not None:
        d = d.filter(F.col("ts") >= F.lit(start).cast("date"))
    return (d.groupBy("ts").agg(F.count_if(F.col("pct") > threshold).alias("n_above"),
                                F.count("pct").alias("n_valid"))
            .withColumn("diffusion", F.coalesce(safe_div(F.col("n_above") * 100.0, F.col("n_valid")), F.lit(0.0))))


def diffusion_stats(index: DataFrame) -> DataFrame:
    """Last, extreme and mean value of a diffusion index and its latest move.

    The index has one row per date; the two newest come from two aggregates."""
    newest = index.agg(F.max("ts")).scalar()
    d = index.select("ts", "diffusion", newest.alias("_newest"))
    s = d.agg(F.max_by("diffusion", "ts").alias("last"),
              F.max_by(F.when(F.col("ts") < F.col("_newest"), F.col("diffusion")),
                       F.when(F.col("ts") < F.col("_newest"), F.col("ts"))).alias("_before"),
              F.max("diffusion").alias("max"), F.min("diffusion").alias("min"),
              F.avg("diffusion").alias("mean"))
    change = F.col("last") - F.col("_before")
    return s.select("last", "max", "min", "mean", change.alias("change"),
                    F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat").alias("direction"))


def growth_heatmap(df: DataFrame, dim: DataFrame, freq: str = "weekly", kind: str = "yoy",
                   native: DataFrame | None = None, n_periods: int | None = None,
                   rule: str | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """Change over the last few periods: long rows with the column number
    ``period`` (1 = newest) and the rank of the series inside its industry."""
    n_periods = n_periods or HEATMAP_PERIODS[freq]
    rows = with_position(df, rule)
    last_pos = rows.agg(F.max("pos")).scalar()
    d = pct_change(rows, CHANGE_PERIODS[freq][kind], keys)
    if native is not None:
        d = d.join(native.select("series").distinct(), "series", "left_semi")
    d = (d.select("*", (last_pos - F.col("pos") + 1).alias("period")).filter(F.col("period") <= n_periods)
         .join(dim.select("series", "industry"), "series", "left")
         .withColumn("industry", F.coalesce("industry", F.lit("未分类"))))
    newest = F.max(F.when(F.col("period") == 1, F.col("pct"))).over(Window.partitionBy(*keys))
    return d.withColumn("newest_pct", newest).select("industry", *keys, "ts", "period", "pct", "newest_pct")


def heatmap_grid(heat: DataFrame, n_periods: int) -> DataFrame:
    """Wide form of :func:`growth_heatmap`, one column per period, sorted."""
    cols = list(range(1, n_periods + 1))
    wide = heat.groupBy("industry", "series").pivot("period", cols).agg(F.first("pct"))
    wide = wide.select("industry", "series", *[F.col(f"`{c}`").alias(f"p{c}") for c in cols])
    return wide.orderBy("industry", F.col("p1").desc_nulls_last(), "series")


def seasonal_band(df: DataFrame, slot: str, current_year: int | None = None,
                  keys: Sequence[str] = SERIES) -> DataFrame:
    """Range of earlier years per week (1-53), month (1-12) or day (1-366) of the
    year, beside this and the previous year's value.

    Weeks are ISO weeks inside calendar years and compare with all years before
    the current one; months and days with the years before the previous one.
    """
    slots, unit = {"week": (53, F.weekofyear), "month": (12, F.month), "day": (366, F.dayofyear)}[slot]
    year = F.lit(current_year) if current_year is not None else F.year(panel_bounds(df)[1])
    d = (df.filter(F.col("value").isNotNull())
         .select(*keys, "ts", "value", unit("ts").alias("slot"), year.alias("_cy")))
    limit = F.col("_cy") if slot == "week" else F.col("_cy") - 1
    hist = F.when(F.year("ts") < limit, F.col("value"))

    def newest(y):
        hit = F.year("ts") == y
        return F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("ts")))
    per = d.groupBy(*keys, "slot").agg(
        F.min(hist).alias("hist_min"), F.max(hist).alias("hist_max"), F.avg(hist).alias("hist_mean"),
        newest(F.col("_cy")).alias("this_year"), newest(F.col("_cy") - 1).alias("last_year"))
    names = ["hist_min", "hist_max", "hist_mean", "this_year", "last_year"]
    # at most 366 slots per series: the grid is completed from a small map
    grid = per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*names)))).alias("m"))
    out = grid.select(*keys, "m", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot"))
    out = out.withColumn("s", F.try_element_at("m", F.col("slot")))
    out = out.select(*keys, "slot", *[F.col(f"s.{n}").alias(n) for n in names])
    if slot != "day":
        return out
    back = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    ahead = running_back(keys, "slot")
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                                          F.last(c, ignorenulls=True).over(ahead)) for c in names[:3]})


def status_counts(log: DataFrame, skipped: Sequence[str] = ()) -> DataFrame:
    """Number of series per transform status, split into checked and skipped."""
    stage = F.when(F.col("status").isin(list(skipped)) | F.col("status").startswith("skipped"), "skipped")
    return (log.withColumn("stage", stage.otherwise("checked")).groupBy("stage", "status")
            .agg(F.count(F.lit(1)).alias("n_series")))


# ---------------------------------------------------------------- pivots

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "median": None,
}


def _aggs(values: Sequence[str], aggs: Sequence[str]) -> list[Column]:
    return [AGGREGATES[a](F.col(v)).alias(f"{v}_{a}") for v in values for a in aggs]


def _grouped(d: DataFrame, keys: Sequence[str], values: Sequence[str], aggs: Sequence[str]) -> DataFrame:
    """Aggregates per key. Medians are exact for groups of any size and join the
    other aggregates on the key."""
    order = [f"{v}_{a}" for v in values for a in aggs]
    plain = [a for a in aggs if a != "median"]
    out = d.groupBy(*keys).agg(*_aggs(values, plain), F.count(F.lit(1)).alias("_rows"))
    for v in values if "median" in aggs else []:
        m = exact_quantile(d, keys, v, name=f"{v}_median").select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], f"{v}_median")
        cond = [F.col(k).eqNullSafe(F.col(f"_q{i}")) for i, k in enumerate(keys)]
        out = out.join(m, cond, "left").drop(*[f"_q{i}" for i in range(len(keys))])
    return out.select(*keys, *order)


def pivot_single(df: DataFrame, value: str, key: str | None = None, period: str | None = None,
                 aggs: Sequence[str] = ("sum",), ts: str = "ts") -> DataFrame:
    """Group one value column by a category or by the year, quarter, month or
    week (``A Q M W``) of its stamp."""
    bins = {"Y": "A", "A": "A", "Q": "Q", "M": "M", "W": "W-SUN"}
    k = F.col(key) if period is None else bin_label(F.col(ts), bins[period])
    return _grouped(df.withColumn("key", k), ["key"], [value], aggs)


def pivot_multi(df: DataFrame, values: Sequence[str], index: Sequence[str], column: str,
                column_values: Sequence, aggs: Sequence[str] = ("sum",), start=None, end=None,
                ts: str = "ts") -> DataFrame:
    """Pivot table over a date range; the column values are listed, so no extra
    job looks for them."""
    d = df
    if start is not None:
        d = d.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1))
    if "median" in aggs:
        d = _grouped(d, [*index, column], values, aggs)
        firsts = [F.first(f"{v}_{a}").alias(f"{v}_{a}") for v in values for a in aggs]
        return d.groupBy(*index).pivot(column, list(column_values)).agg(*firsts)
    return d.groupBy(*index).pivot(column, list(column_values)).agg(*_aggs(values, aggs))


def with_period_labels(df: DataFrame, periods: Sequence[str], ts: str = "ts") -> DataFrame:
    return df.withColumns({p: period_label(F.col(ts), p) for p in periods})


def pivot_grouped(df: DataFrame, mapping: DataFrame, index: Sequence[str], groups: Sequence[str],
                  aggs: Sequence[str] = ("sum",)) -> DataFrame:
    """Pivot with the variables collected into groups by ``mapping(series, group)``."""
    return pivot_multi(df.join(mapping, "series"), ["value"], index, "group", groups, aggs)


def previous_period(df: DataFrame, n: int, rule: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Value beside the one ``n`` positions earlier (1 = period before, 4/12/52/365 = year before)."""
    return with_position(df, rule).withColumn("previous", lag_at("value", n, keys)).drop("pos")


def same_period_last_year(df: DataFrame, period: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Latest month by day, or latest quarter by month, against a year earlier."""
    last = panel_bounds(df)[1]
    d = df.select("*", last.alias("_last"))
    if period == "month":
        same, slot = F.month("ts") == F.month("_last"), F.dayofmonth("ts")
    else:
        same, slot = F.quarter("ts") == F.quarter("_last"), F.pmod(F.month("ts") - 1, F.lit(3)) + 1
    pick = lambda back: F.max_by(F.when(F.year("ts") == F.year("_last") - back, F.col("value")),
                                 F.when(F.year("ts") == F.year("_last") - back, F.col("ts")))
    near = F.year("ts").between(F.year("_last") - 1, F.year("_last"))
    return (d.filter(same & near).groupBy(*keys, slot.alias("slot"))
            .agg(pick(0).alias("current"), pick(1).alias("year_ago")))

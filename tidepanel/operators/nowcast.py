"""Nowcast metrics, forecasts, news decomposition and attribution.

Model tables come from :mod:`tidepanel.operators.factor`: ``loadings(panel,
series, l, r, mean, std)``, ``state(panel, n_t, a, q, x0, p0)``, factor tables
with an array of scores per (panel, date).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidepanel.functions.calendar import bin_ordinal, month_last_friday
from tidepanel.functions.scalars import corr_guarded
from tidepanel.operators.clean import interpolate_linear
from tidepanel.operators.factor import (
    INNOVATION_JITTER, _upper, dot, factor_products, kalman_smoother, model_panel,
)
from tidepanel.operators.panel import densify
from tidepanel.plans.session import cut_lineage

# ---------------------------------------------------------------- metrics


def _month(c: str = "ts") -> Column:
    return F.trunc(c, "MM").cast("date")


def _monthly_target(target: DataFrame, keys: Sequence[str], pick) -> DataFrame:
    """One target value per month with that of the previous month present."""
    m = target.filter(F.col("value").isNotNull()).groupBy(*keys, _month().alias("month")).agg(pick("value", "ts").alias("target"))
    part = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("month")  # one row per month
    return m.withColumn("previous_target", F.lag("target").over(part))


def _errors(inside: Column, name: str) -> list[Column]:
    e = F.when(inside, F.col("nowcast") - F.col("target"))
    return [F.sqrt(F.avg(e * e)).alias(f"{name}_rmse"), F.avg(F.abs(e)).alias(f"{name}_mae")]


METRICS = ("is_rmse", "oos_rmse", "is_mae", "oos_mae", "is_hit_rate", "oos_hit_rate")


def nowcast_metrics(nowcast: DataFrame, target: DataFrame, train_end: str, oos_start: str, oos_end: str) -> DataFrame:
    """Per panel: error of the weekly nowcast against its month's target inside
    and outside the training span, and the share of weeks that get the direction
    from the previous month's target right (mean per month, then over months).
    No data gives NULL. ``nowcast(panel, ts, value)``, ``target([panel,] ts, value)``."""
    d = lambda s: F.lit(s).cast("date")
    keys = ["panel"] if "panel" in target.columns else []
    t = _monthly_target(target, keys, F.max_by)
    n = nowcast.filter(F.col("value").isNotNull()).select("panel", "ts", F.col("value").alias("nowcast"), _month().alias("month"))
    j = n.join(t, [*keys, "month"])
    j = j.withColumn("hit", F.when(F.col("previous_target").isNotNull(),
                                   (F.signum(F.col("target") - F.col("previous_target")) == F.signum(F.col("nowcast") - F.col("previous_target"))).cast("int")))
    inside, outside = F.col("ts") <= d(train_end), F.col("ts").between(d(oos_start), d(oos_end))
    sums = []
    for name, span in (("is", inside), ("oos", outside)):
        e = F.when(span, F.col("nowcast") - F.col("target"))
        sums += [F.sum(e * e).alias(f"{name}_ss"), F.sum(F.abs(e)).alias(f"{name}_sa"), F.count(e).alias(f"{name}_n")]
    per = j.groupBy("panel", "month").agg(F.avg("hit").alias("hit"), *sums)
    end = F.last_day("month")
    out = per.groupBy("panel").agg(
        *[F.sqrt(F.try_divide(F.sum(f"{n}_ss"), F.sum(f"{n}_n"))).alias(f"{n}_rmse") for n in ("is", "oos")],
        *[F.try_divide(F.sum(f"{n}_sa"), F.sum(f"{n}_n")).alias(f"{n}_mae") for n in ("is", "oos")],
        (F.avg(F.when(end <= d(train_end), F.col("hit"))) * 100).alias("is_hit_rate"),
        (F.avg(F.when(end.between(d(oos_start), d(oos_end)), F.col("hit"))) * 100).alias("oos_hit_rate"))
    return out.select("panel", *METRICS)


def month_last_friday_metrics(nowcast: DataFrame, target: DataFrame, validation_end: str) -> DataFrame:
    """The last Friday's nowcast of each month against the month's first target:
    in sample up to the end of validation, out of sample after it; hits compare
    consecutive changes inside each span."""
    keys = ["panel"] if "panel" in target.columns else []
    fri = nowcast.filter((F.weekday("ts") == 4) & F.col("value").isNotNull())
    n = fri.groupBy("panel", _month().alias("month")).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("nowcast"))
    t = _monthly_target(target, keys, F.min_by).drop("previous_target")
    j = n.join(t, [*keys, "month"]).withColumn("span", F.when(F.col("ts") <= F.lit(validation_end).cast("date"), "is").otherwise("oos"))
    w = Window.partitionBy("panel", "span").orderBy("ts")  # one row per month
    dt, dn = F.col("target") - F.lag("target").over(w), F.col("nowcast") - F.lag("nowcast").over(w)
    j = j.withColumn("hit", F.when(dt.isNotNull(), (F.signum(dt) == F.signum(dn)).cast("int")))
    s = lambda n: F.col("span") == n
    out = j.groupBy("panel").agg(*_errors(s("is"), "is"), *_errors(s("oos"), "oos"),
                                 *[(F.avg(F.when(s(n), F.col("hit"))) * 100).alias(f"{n}_hit_rate") for n in ("is", "oos")])
    return out.select("panel", *METRICS)


def aligned_nowcast_table(nowcast: DataFrame, target: DataFrame) -> DataFrame:
    """All Friday nowcasts; the last Friday of a month carries next month's target."""
    fri = nowcast.filter(F.weekday("ts") == 4).select("ts", F.col("value").alias("nowcast"))
    last = fri.groupBy(_month().alias("month")).agg(F.max("ts").alias("ts"))
    t = target.filter(F.col("value").isNotNull()).groupBy(F.add_months(_month(), -1).alias("month")).agg(F.max_by("value", "ts").alias("target"))
    return fri.join(last.join(t, "month").select("ts", "target"), "ts", "left")


def nowcast_vs_actual(nowcast: DataFrame, target: DataFrame) -> DataFrame:
    """Both on the weekly calendar from the first target to the last of either.
    A target counts at the Friday that closes its week."""
    from tidepanel.functions.calendar import bin_label

    fri = bin_label(F.col("ts"), "W-FRI")
    n = nowcast.select(fri.alias("ts"), F.lit("nowcast").alias("series"), "value")
    t = target.filter(F.col("value").isNotNull()).select(fri.alias("ts"), F.lit("target").alias("series"), "value")
    start = t.agg(F.min("ts")).scalar()
    both = n.unionByName(t).filter(F.col("ts") >= start)
    g = both.groupBy("ts").agg(F.max_by(F.when(F.col("series") == "nowcast", F.col("value")), F.when(F.col("series") == "nowcast", F.col("ts"))).alias("nowcast"),
                               F.max_by(F.when(F.col("series") == "target", F.col("value")), F.when(F.col("series") == "target", F.col("ts"))).alias("target"))
    # the grid has one row per week, a single short series
    return densify(g.withColumn("series", F.lit("grid")), "W-FRI", span="series").select("ts", "nowcast", "target")


def looks_standardised(target: DataFrame) -> DataFrame:
    s = target.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.count("value").alias("n"))
    flag = (F.abs("mean") < 0.5) & (F.col("std") > 0.8) & (F.col("std") < 1.2) & (F.col("range") < 8) & (F.col("n") > 10)
    return s.withColumn("standardised", F.coalesce(flag, F.lit(False)))


# ---------------------------------------------------------------- forecasts

def _powers(k: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def power(a: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.matrix_power(np.asarray(x, dtype=float).reshape(k, k), int(n)).ravel() for x, n in zip(a, h)])
    return power


def power_table(state: DataFrame, k: int, steps: int) -> DataFrame:
    """(panel, h, ah): powers of the transition matrix for h = 0..steps."""
    d = state.select("panel", "a", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("h"))
    return d.select("panel", "h", _powers(k)("a", "h").alias("ah"))


def _powers_for(model: dict[str, DataFrame], steps: DataFrame, k: int) -> DataFrame:
    """(h, ah) for the distinct ``h`` of ``steps``, whatever their size."""
    a = _one_state(model).agg(F.first("a")).scalar()
    return steps.select("h").distinct().select("h", _powers(k)(a, "h").alias("ah"))


def _one_state(model: dict[str, DataFrame]) -> DataFrame:
    """The parameters all panels of one fitted model share, as one row."""
    return model["state"].agg(F.first(F.struct("panel", "a")).alias("s")).select("s.*")


def matvec(a: Column, x: Column, k: int) -> Column:
    """Flat k-by-k matrix times vector."""
    return F.array(*[dot(F.slice(a, i * k + 1, k), x) for i in range(k)])


def forecast_to_month_end(model: dict[str, DataFrame], target: str, k: int, mean: float | None = None, std: float | None = None,
                          rule: str = "W-FRI") -> DataFrame:
    """From every date's filtered state to the last Friday of its month; the steps
    are weeks, so only weekly models have this forecast."""
    if not rule.startswith("W"):
        raise ValueError(f"steps to the month's last Friday are weeks; the model's rule is {rule}")
    x = model["filtered"].withColumn("target_ts", F.greatest(month_last_friday(F.col("ts")), F.col("ts")))
    x = x.withColumn("h", F.floor(F.datediff("target_ts", "ts") / F.lit(7)).cast("int"))
    l = model["loadings"].filter((F.col("series") == target) & F.col("l").isNotNull()).select("panel", "l", "mean")
    d = x.join(power_table(model["state"], k, 5), ["panel", "h"]).join(l, "panel")
    fit = dot(F.col("l"), matvec(F.col("ah"), F.col("x"), k))
    value = fit + F.col("mean") if mean is None else fit * F.lit(float(std)) + F.lit(float(mean))
    return d.select("panel", "ts", "target_ts", "h", fit.alias("nowcast_std"), value.alias("nowcast"))


def nowcast_evolution(forecast: DataFrame, month: str) -> DataFrame:
    """Each Friday of the target month looking at the month's last Friday present."""
    m = F.lit(f"{month}-01").cast("date")
    return forecast.filter((_month() == m) & (F.weekday("ts") == 4)).select("panel", "ts", "target_ts", F.col("h").alias("horizon_weeks"), "nowcast_std", "nowcast")


def state_forecast(model: dict[str, DataFrame], k: int, steps: int, rule: str = "W-FRI") -> DataFrame:
    """(panel, h, ts, x, p): states ``steps`` calendar steps of ``rule`` past the
    last date, with covariance P <- A P A' + Q."""
    from tidepanel.operators.factor import _shift

    last = model["filtered"].groupBy("panel").agg(F.max("ts").alias("ts"), F.max_by("x", "ts").alias("x"), F.max_by("p", "ts").alias("p"))
    d = last.join(model["state"].select("panel", "a", "q"), "panel")

    def ahead(batches):
        for pdf in batches:
            rows = []
            for panel, ts, x, p, a, q in pdf[["panel", "ts", "x", "p", "a", "q"]].itertuples(index=False):
                x, p, a, q = np.asarray(x), *(np.asarray(v).reshape(k, k) for v in (p, a, q))
                for h in range(1, steps + 1):
                    x, p = a @ x, a @ p @ a.T + q
                    rows.append((panel, h, ts, x.tolist(), p.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["panel", "h", "ts", "x", "p"])
    out = d.mapInPandas(ahead, "panel string, h int, ts date, x array<double>, p array<double>")
    return out.withColumn("ts", _shift(F.col("ts"), rule, F.col("h")))


# ---------------------------------------------------------------- vintages and news

def apply_vintage(model: dict[str, DataFrame], data: DataFrame, k: int, interpolate: bool = True, rule: str = "W-FRI") -> dict[str, DataFrame]:
    """Run the filter with fixed parameters over new data: ``data(panel, series,
    ts, value)``, the panel being the vintage; parameters are those of the one
    fitted panel of ``model``, centring included."""
    keys = ("panel", "series")
    data = cut_lineage(data)
    d = densify(data, rule, keys) if interpolate else data
    d = interpolate_linear(d, keys) if interpolate else d
    m = model_panel(cut_lineage(d.filter(F.col("value").isNotNull())), rule).drop("mean", "std", "y", "z")
    par = model["loadings"].filter(F.col("l").isNotNull()).select("series", "l", "r", "mean", "std")
    m = cut_lineage(m.join(par.select("series", "mean", "std"), "series").withColumn("y", F.col("value") - F.col("mean")))
    panels = m.groupBy("panel").agg(F.max("n_t").alias("n_t"))
    par = m.select("panel", "series").distinct().join(par, "series")
    one = model["state"].agg(F.first(F.struct("a", "q", "x0", "p0"))).scalar()  # one fitted panel, one row
    state = panels.select("panel", "n_t", one.alias("s")).select("panel", "n_t", "s.a", "s.q", "s.x0", "s.p0")
    scan = cut_lineage(kalman_smoother(m, par, state, k)).filter("t >= 0")
    from tidepanel.operators.factor import _stamps

    stamps = _stamps(m, rule)
    filt = scan.select("panel", "t", F.col("xf").alias("x"), F.col("xm").alias("x_minus"), "p").join(stamps, ["panel", "t"])
    smooth = scan.select("panel", "t", F.col("xs").alias("f")).join(stamps, ["panel", "t"])
    return {"panel": m, "loadings": par, "state": state, "filtered": filt, "smoothed": smooth}


def news(now: dict[str, DataFrame], previous: dict[str, DataFrame], target: str, impact_ts: str, k: int,
         rule: str = "W-FRI", flip: bool = False) -> DataFrame:
    """New or revised values between two vintages and their effect on the target
    at ``impact_ts``.

    forecast = loadings times the previous vintage's predicted state (past its
    end: propagated from its last smoothed state); news = observed - forecast
    (``flip`` for the opposite sign); weight = l_target' A^h K[:, j] with the
    current vintage's gain; impact = weight * news. Values are centred in
    ``news`` and on the original scale in ``observed`` and ``forecast``."""
    par = now["loadings"].select("series", "l", "r", "mean").dropDuplicates(["series"])
    a = now["panel"].filter(F.col("ts") <= F.lit(impact_ts).cast("date")).select("series", "ts", F.col("y").alias("y_now"))
    b = previous["panel"].select("series", "ts", F.col("y").alias("y_prev"))
    items = cut_lineage(a.join(b, ["series", "ts"], "left").filter(~F.col("y_now").eqNullSafe(F.col("y_prev"))))
    # predicted states of the previous vintage, continued past its last date
    end = previous["smoothed"].agg(F.struct(F.max("ts").alias("ts"), F.max_by("f", "ts").alias("f")).alias("e")).scalar()
    pred = previous["filtered"].select("ts", "x_minus")
    days = items.select("ts").distinct().join(pred, "ts", "left").select("ts", "x_minus", end.alias("e"))
    ahead = bin_ordinal(F.col("ts"), rule) - bin_ordinal(F.col("e.ts"), rule)
    days = cut_lineage(days.withColumn("h", F.when(F.col("x_minus").isNull(), F.greatest(ahead, F.lit(1))).cast("int")))
    days = days.join(_powers_for(now, days.filter("h is not null"), k), "h", "left")
    days = days.select("ts", F.coalesce("x_minus", matvec(F.col("ah"), F.col("e.f"), k)).alias("x_minus"))
    gain = now["filtered"].select("ts", "p")
    l_t = par.filter(F.col("series") == target).agg(F.first("l")).scalar()
    d = items.join(days, "ts").join(gain, "ts").join(par, "series")
    to_go = (bin_ordinal(F.lit(impact_ts).cast("date"), rule) - bin_ordinal(F.col("ts"), rule)).cast("int")
    ah = _powers_for(now, items.select(to_go.alias("h")), k)
    d = d.select("*", l_t.alias("_lt"), to_go.alias("h")).join(ah, "h")
    forecast = dot(F.col("l"), F.col("x_minus"))
    column = F.transform(matvec(F.col("p"), F.col("l"), k), lambda v: F.try_divide(v, F.col("r") + INNOVATION_JITTER))
    weight = dot(F.col("_lt"), matvec(F.col("ah"), column, k))
    diff = F.col("y_now") - forecast
    out = d.select("ts", "series", (F.col("y_now") + F.col("mean")).alias("observed"), (forecast + F.col("mean")).alias("forecast"),
                   (-diff if flip else diff).alias("news"), weight.alias("weight"))
    out = out.withColumn("impact", F.col("weight") * F.col("news"))
    return out.orderBy("ts", F.abs("impact").desc(), "series")


def news_by_industry(model: dict[str, DataFrame], target: str, target_std: float, month: str, dim: DataFrame,
                     industries: Sequence[str], k: int, default: str = "其他未分类", flip: bool = False, min_size: float = 1e-6) -> DataFrame:
    """Contribution of each industry's innovations to the nowcast of the month's
    last Friday, one row per Friday of the month and one column per industry;
    industries that are not listed count under ``default``."""
    m = F.lit(f"{month}-01").cast("date")
    obs = model["panel"].filter(_month() == m).select("series", "ts", "y")
    par = model["loadings"].filter(F.col("l").isNotNull()).select("series", "l", "r").dropDuplicates(["series"])
    l_t = par.filter(F.col("series") == target).agg(F.first("l")).scalar()
    ah = power_table(_one_state(model), k, 5).select("h", "ah")
    last = F.max("ts").over(Window.partitionBy(F.trunc("ts", "MM")))  # at most five Fridays
    fri = model["filtered"].filter((_month() == m) & (F.weekday("ts") == 4)).select("ts", "x_minus", "p").withColumn("_last", last)
    fri = fri.withColumn("h", F.floor(F.datediff("_last", "ts") / F.lit(7)).cast("int")).join(ah, "h")
    d = obs.join(fri, "ts").join(par, "series").select("*", l_t.alias("_lt"))
    innovation = F.col("y") - dot(F.col("l"), F.col("x_minus"))
    column = F.transform(matvec(F.col("p"), F.col("l"), k), lambda v: F.try_divide(v, F.col("r") + INNOVATION_JITTER))
    c = dot(F.col("_lt"), matvec(F.col("ah"), column, k)) * (-innovation if flip else innovation) * F.lit(float(target_std))
    d = d.withColumn("c", c).filter(F.abs("c") > min_size).join(dim.select("series", "industry"), "series", "left")
    names = list(dict.fromkeys([*industries, default]))
    wide = (d.withColumn("industry", F.when(F.col("industry").isin(names), F.col("industry")).otherwise(F.lit(default))).groupBy("ts").pivot("industry", names).agg(F.sum("c")))
    out = fri.select("ts").join(wide, "ts", "left")
    return out.select("ts", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


# ---------------------------------------------------------------- attribution

def factor_contribution(data: DataFrame, factors: DataFrame, target: str, k: int) -> DataFrame:
    """Regression (with constant) of the target on the factors: squared loadings
    as shares of total and of common variance. ``data(panel, series, t, value)``,
    ``factors(panel, t, f)``."""
    one = data.filter(F.col("series") == target)
    prod = factor_products(one, factors, k, "value")

    @F.pandas_udf(ArrayType(DoubleType()))
    def slopes(n: pd.Series, ff: pd.Series, fy: pd.Series, f: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.pinv(_upper(s, k) - np.outer(m, m) / c, hermitian=True) @ (np.asarray(b) - np.asarray(m) * (yy / c))
                          for c, s, b, m, yy in zip(n, ff, fy, f, y)])
    d = prod.withColumn("b", slopes("n", "ff", "fy", "f", "y"))
    total = F.try_divide("yy", "n") - F.pow(F.try_divide("y", "n"), F.lit(2))
    common = F.aggregate(F.transform("b", lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    d = d.select("panel", total.alias("_total"), common.alias("_common"), F.posexplode("b").alias("_i", "loading"))
    sq = F.col("loading") * F.col("loading")
    return d.filter(F.col("_total") >= 1e-9).select(
        "panel", (F.col("_i") + 1).alias("factor"), "loading", sq.alias("squared_loading"),
        F.when(F.col("_common") > 1e-9, F.try_divide(sq * 100, F.col("_common"))).alias("common_pct"),
        F.try_divide(sq * 100, F.col("_total")).alias("total_pct"))


def factor_rows(factors: DataFrame) -> DataFrame:
    """(panel, ts, factor, score): array of scores to rows."""
    return factors.select("panel", "ts", F.posexplode("f").alias("_i", "score")).select("panel", "ts", (F.col("_i") + 1).alias("factor"), "score")


def _xy(data: DataFrame, scores: DataFrame) -> DataFrame:
    on = ["panel", "ts"] if "panel" in data.columns and "panel" in scores.columns else ["ts"]
    return data.filter(F.col("value").isNotNull()).join(scores, on)


def variable_r2(data: DataFrame, scores: DataFrame) -> DataFrame:
    """R2 of every series on every factor alone: ``data(series, ts, value)``,
    ``scores(ts, factor, score)``."""
    r = corr_guarded(F.col("score"), F.col("value"))
    g = _xy(data, scores).groupBy("series", "factor").agg(F.count(F.lit(1)).alias("n"), r.alias("_r"))
    return g.filter(F.col("n") >= 2).select("series", "factor", "n", (F.col("_r") * F.col("_r")).alias("r2"))


def _sums(g, x: str = "score", y: str = "value") -> list[Column]:
    x, y = F.col(x), F.col(y)
    return [F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy")]


def group_factor_r2(data: DataFrame, scores: DataFrame, dim: DataFrame, column: str = "industry") -> DataFrame:
    """Pooled R2 of an industry's (or type's) series on one factor, at least
    three points per series, floored at zero."""
    g = _xy(data, scores).groupBy("series", "factor").agg(*_sums(None)).filter(F.col("n") >= 3)
    rss = F.col("syy") - F.coalesce(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    d = g.withColumn("rss", rss).join(dim.select("series", column), "series")
    out = d.groupBy(column, "factor").agg(F.sum("rss").alias("_r"), F.sum("syy").alias("_t"), F.count(F.lit(1)).alias("n_series"))
    return out.select(column, "factor", "n_series", F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("_r"), F.col("_t"))).alias("r2"))


def industry_r2(data: DataFrame, factors: DataFrame, dim: DataFrame, k: int) -> DataFrame:
    """Pooled R2 of an industry's series on all k factors with constant; a series
    needs k + 2 points. ``data(panel, series, t, value)``."""
    prod = factor_products(data, factors, k, "value").filter(F.col("n") >= k + 2)

    @F.pandas_udf(DoubleType())
    def rss(n: pd.Series, ff: pd.Series, fy: pd.Series, f: pd.Series, y: pd.Series, yy: pd.Series) -> pd.Series:
        out = []
        for c, s, b, m, y_, q in zip(n, ff, fy, f, y, yy):
            m = np.asarray(m)
            sxx, sxy = _upper(s, k) - np.outer(m, m) / c, np.asarray(b) - m * (y_ / c)
            out.append(max(q - y_ * y_ / c - sxy @ np.linalg.pinv(sxx, hermitian=True) @ sxy, 0.0))
        return pd.Series(out)
    d = prod.withColumn("rss", rss("n", "ff", "fy", "f", "y", "yy")).withColumn("tss", F.col("yy") - F.try_divide(F.col("y") * F.col("y"), F.col("n")))
    d = d.join(dim.select("series", "industry"), "series")
    g = d.groupBy("panel", "industry").agg(F.sum("rss").alias("_r"), F.sum("tss").alias("_t"), F.count(F.lit(1)).alias("n_series"))
    return g.select("panel", "industry", "n_series", (1 - F.try_divide(F.col("_r"), F.col("_t"))).alias("r2"))


def driving_factor(r2: DataFrame, column: str = "industry") -> DataFrame:
    """Per industry the factor with the highest R2 (the first on a tie)."""
    best = r2.groupBy(column).agg(F.max(F.struct("r2", (-F.col("factor")).alias("f"))).alias("b"))
    return best.select(column, (-F.col("b.f")).alias("factor"), F.col("b.r2").alias("r2"))


def loading_rows(loadings: DataFrame) -> DataFrame:
    return (loadings.filter(F.col("l").isNotNull()).select("panel", "series", F.posexplode("l").alias("_i", "loading"))
            .select("panel", "series", (F.col("_i") + 1).alias("factor"), "loading"))


def top_loadings(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(top n rows per factor by absolute loading, union of their names)."""
    w = Window.partitionBy("factor").orderBy(F.abs("loading").desc(), "series")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top, top.select("series").distinct()


def loading_groups(loadings: DataFrame, n_groups: int, seed: int = 7) -> DataFrame:
    """Variables grouped by similar loading vectors (bisecting k-means)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    d = loadings.filter(F.col("l").isNotNull()).select("series", "l", array_to_vector("l").alias("features"))
    model = BisectingKMeans(k=n_groups, seed=seed, featuresCol="features", predictionCol="group").fit(d)
    return model.transform(d).select("series", "l", "group")


def loading_stability(full: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cross correlations, matches) of two sets of ``(series, factor, loading)``:
    the one-to-one matching with the largest sum of signed correlations; a negative
    one flips the sign. Factors are few, so the matching works on one k-by-k table."""
    a = full.select("series", F.col("factor").alias("factor_full"), F.col("loading").alias("x"))
    b = train.select("series", F.col("factor").alias("factor_train"), F.col("loading").alias("y"))
    corr = a.join(b, "series").groupBy("factor_full", "factor_train").agg(corr_guarded(F.col("x"), F.col("y")).alias("corr"))
    kind = corr.schema["factor_full"].dataType.simpleString()
    match = corr.groupBy().applyInPandas(_assign, f"factor_full {kind}, factor_train {kind}, corr double, flip boolean")
    return corr, match


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best one-to-one matching by dynamic programming over sets of used columns."""
    grid = pdf.pivot(index="factor_full", columns="factor_train", values="corr").sort_index().sort_index(axis=1)
    gain = grid.fillna(0.0).to_numpy()
    wide = gain if gain.shape[0] <= gain.shape[1] else gain.T
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in wide:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, picks) in best.items():
            for j, v in enumerate(row):
                if not used >> j & 1:
                    got = (total + v, (*picks, j))
                    if used | 1 << j not in step or got[0] > step[used | 1 << j][0] + 1e-12:
                        step[used | 1 << j] = got
        best = step
    picks = max(best.values(), key=lambda b: b[0])[1] if best else ()
    pairs = [(i, j) if wide is gain else (j, i) for i, j in enumerate(picks)]
    rows = [(grid.index[i], grid.columns[j], grid.iloc[i, j], bool(grid.iloc[i, j] < 0)) for i, j in pairs]
    return pd.DataFrame(rows, columns=["factor_full", "factor_train", "corr", "flip"])


def variable_blocks(dim: DataFrame, default: str = "其他") -> tuple[DataFrame, DataFrame]:
    """(series, block) with block = type, else industry, else the default; and
    the first guess for the number of factors."""
    d = dim.select("series", F.coalesce("type", "industry", F.lit(default)).alias("block"), "industry")
    hint = d.agg((F.greatest(F.count_distinct("industry"), F.count_distinct("block")) + 1).alias("k"))
    return d.select("series", "block"), hint


def block_members(blocks: DataFrame) -> DataFrame:
    """Members of each block in order, one row per member."""
    return blocks.select("block", "series").distinct().orderBy("block", "series")

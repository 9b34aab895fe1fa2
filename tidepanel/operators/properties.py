"""Stationarity, lagged correlation, divergence, DTW and win rate over panels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StructField, StructType)

from tidepanel.functions.scalars import corr_guarded
from tidepanel.functions.unitroot import KPSS_TREND, adf_batch
from tidepanel.operators.panel import SERIES, series_window
from tidepanel.plans.session import cut_lineage, spread

# ---------------------------------------------------------------- stationarity


_ADF = StructType([StructField("n", IntegerType()), StructField("tau", DoubleType()), StructField("lags", IntegerType()), StructField("p", DoubleType())])


def _adf_table(df: DataFrame, trend: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """ADF of every series at once: a series is gathered as one array (no longer than
    its calendar), and a call solves the regressions of a whole batch of them."""
    @F.pandas_udf(_ADF)
    def solve(values: pd.Series) -> pd.DataFrame:
        ys = [np.asarray(v, dtype=float) for v in values]
        use = [i for i, y in enumerate(ys) if len(y) >= 5 and np.ptp(y) > 0]
        got = dict(zip(use, adf_batch([ys[i] for i in use], trend)))
        rows = [(len(y), *(got.get(i) or (None, None, None))) for i, y in enumerate(ys)]
        return pd.DataFrame(rows, columns=["n", "tau", "lags", "p"])
    live = df.filter(F.col("value").isNotNull())
    vec = live.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).getField("value").alias("_v"))
    out = vec.withColumn("_r", solve("_v"))
    return out.select(*keys, F.col("_r.n").alias("n"), F.col("_r.tau").alias("tau"), F.col("_r.lags").alias("lags"), F.col("_r.p").alias("p_value"))


def _difference(df: DataFrame, log: bool, order: int, keys: Sequence[str]) -> DataFrame:
    v = F.when(F.col("value") > 0, F.ln("value")) if log else F.col("value")
    d = df.withColumn("value", v)
    for _ in range(order):
        d = d.withColumn("value", F.col("value") - F.lag("value").over(series_window(keys)))
    return d


def adf_screen(df: DataFrame, alpha: float = 0.05, method: str = "keep", order: int = 1,
               keys: Sequence[str] = SERIES) -> tuple[DataFrame, DataFrame]:
    """(summary, panel): trend ADF per series; non-stationary ones are differenced
    (``diff`` or ``log_diff``) and join the panel only when that helped.

    The panel is read several times, so it is written once at the start."""
    df = cut_lineage(df)
    first = _adf_table(df, "ct", keys).select(
        *keys, F.col("p_value").alias("p_original"), (F.col("p_value") < alpha).alias("stationary_original"))
    if method == "keep":
        s = first.select("*", F.when(~F.col("stationary_original"), "kept_nonstationary").otherwise("original").alias("method"),
                         F.lit(None).cast("double").alias("p_processed"), F.col("stationary_original").alias("stationary"))
        return s, df
    first = cut_lineage(first)
    todo = first.filter(~F.col("stationary_original"))
    if method == "log_diff":
        low = df.groupBy(*keys).agg(F.min("value").alias("_low"))
        todo = todo.join(low.filter(F.col("_low") > 0).select(*keys), list(keys), "left_semi")
    changed = _difference(df.join(todo.select(*keys), list(keys), "left_semi"), method == "log_diff", order, keys)
    second = cut_lineage(_adf_table(changed, "ct", keys).select(*keys, F.col("p_value").alias("p_processed")))
    s = first.join(second, list(keys), "left")
    done = F.col("p_processed").isNotNull()
    s = s.select("*", F.when(done, f"{method}{order}").when(~F.col("stationary_original"), f"{method}{order}_not_applicable")
                 .otherwise("original").alias("method"),
                 F.when(done, F.col("p_processed") < alpha).otherwise(F.col("stationary_original")).alias("stationary"))
    good = second.filter(F.col("p_processed") < alpha).select(*keys)
    extra = changed.join(good, list(keys), "left_semi").withColumn("series", F.concat("series", F.lit(f"_{method}{order}")))
    return s, df.unionByName(extra)


def ensure_stationary(df: DataFrame, alpha: float = 0.05, skip: DataFrame | None = None,
                      keys: Sequence[str] = SERIES) -> tuple[DataFrame, DataFrame]:
    """(panel, log): keep the level when ADF (constant) rejects the unit root,
    else log-difference (all values positive) or difference; empty and constant
    series leave with a reason. Series listed in ``skip`` pass unchanged.

    The panel and the test results are read several times, so both are written
    once."""
    on = list(keys)
    df = cut_lineage(df)
    shape = df.groupBy(*on).agg(F.count("value").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    if skip is not None:
        shape = shape.join(skip.select("series").distinct().withColumn("_skip", F.lit(True)), "series", "left")
    else:
        shape = shape.withColumn("_skip", F.lit(None).cast("boolean"))
    pre = (F.when(F.col("_skip"), "skipped_by_request").when(F.col("_n") == 0, "skipped_empty")
           .when(F.col("_lo") == F.col("_hi"), "skipped_constant"))
    shape = shape.withColumn("_pre", pre)
    test = df.join(shape.filter("_pre is null").select(*on), on, "left_semi")
    level = _adf_table(test, "c", keys).select(*on, F.col("p_value").alias("p_level"))
    plan = shape.join(level, on, "left").withColumn(
        "_kind", F.when(F.col("_pre").isNotNull() | F.col("p_level").isNull() | (F.col("p_level") < alpha), "level")
        .when(F.col("_lo") > 0, "log_diff").otherwise("diff"))
    plan = cut_lineage(plan)
    w = series_window(keys)
    v = F.col("value")
    logs = F.when(v > 0, F.ln(v))
    out = df.join(plan.select(*on, "_kind", "_pre"), on)
    out = out.withColumn("value", F.when(F.col("_kind") == "log_diff", logs - F.lag(logs).over(w))
                         .when(F.col("_kind") == "diff", v - F.lag(v).over(w)).otherwise(v))
    changed = out.filter(F.col("_kind") != "level").select(*on, "ts", "value")
    again = changed.groupBy(*on).agg(F.count("value").alias("_m"), F.min("value").alias("_a"), F.max("value").alias("_z"))
    again = again.join(_adf_table(changed, "c", keys).select(*on, F.col("p_value").alias("p_transformed")), on, "left")
    log = plan.join(again, on, "left")
    kind = F.col("_kind")
    status = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
              .when((kind == "level") & F.col("p_level").isNull(), "level_test_error").when(kind == "level", "level")
              .when(F.coalesce("_m", F.lit(0)) == 0, F.concat(F.lit("skipped_"), kind, F.lit("_empty")))
              .when(F.col("_a") == F.col("_z"), F.concat(F.lit("skipped_"), kind, F.lit("_constant")))
              .when(F.col("p_transformed").isNull(), F.concat(kind, F.lit("_test_error")))
              .when(F.col("p_transformed") < alpha, kind).otherwise(F.concat(kind, F.lit("_still_nonstat"))))
    log = cut_lineage(log.select(*on, status.alias("status"), "p_level", "p_transformed"))
    gone = log.filter(F.col("status").startswith("skipped_") & (F.col("status") != "skipped_by_request")).select(*on)
    return out.select(*on, "ts", "value").join(gone, on, "left_anti"), log


def kpss(df: DataFrame, alpha: float = 0.05, keys: Sequence[str] = SERIES) -> DataFrame:
    """Trend KPSS per series, in built-in expressions: residuals by regression on
    the position, long-run variance from lagged products of the residual array
    (an array is as long as the calendar)."""
    live = df.filter(F.col("value").isNotNull())
    d = live.withColumn("t", F.row_number().over(series_window(keys)).cast("double"))
    fit = Window.partitionBy(*keys)
    d = d.withColumns({"_b": F.regr_slope("value", "t").over(fit), "_a": F.regr_intercept("value", "t").over(fit)})
    d = d.withColumn("e", F.col("value") - F.col("_a") - F.col("_b") * F.col("t"))
    d = d.withColumn("s", F.sum("e").over(series_window(keys).rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("_s2"),
        F.transform(F.array_sort(F.collect_list(F.struct("t", "e"))), lambda x: x["e"]).alias("_e"))
    e, n = F.col("_e"), F.col("n")

    def auto(i: Column) -> Column:  # sum of e(t) e(t-i)
        prod = F.zip_with(F.slice(e, i + 1, n - i), F.slice(e, F.lit(1), n - i), lambda x, y: x * y)
        return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    g = g.withColumn("_c", F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int"))
    lags = F.sequence(F.lit(1), F.col("_c"))
    g = g.withColumn("_p", F.transform(lags, lambda i: F.struct(i.alias("i"), F.try_divide(auto(i), n / 2.0).alias("v"))))
    s0 = F.try_divide(auto(F.lit(0)), n.cast("double")) + total(F.transform("_p", lambda x: x["v"]))
    s1 = total(F.transform("_p", lambda x: x["i"] * x["v"]))
    ratio = F.try_divide(s1, s0)
    gamma = F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
    g = g.withColumn("lags", F.least(F.floor(gamma * F.pow(n, F.lit(1.0 / 3.0))), n - 1).cast("int"))
    weights = F.transform(F.sequence(F.lit(0), F.col("lags")), lambda i: F.when(i == 0, auto(F.lit(0))).otherwise(
        F.lit(2.0) * (F.lit(1.0) - F.try_divide(i.cast("double"), F.col("lags") + 1.0)) * auto(i)))
    g = g.withColumn("stat", F.try_divide(F.col("_s2") / (n.cast("double") * n), F.try_divide(total(weights), n.cast("double"))))
    x, p = F.col("stat"), F.lit(KPSS_TREND[-1][1])
    for (c0, p0), (c1, p1) in reversed(list(zip(KPSS_TREND, KPSS_TREND[1:]))):
        p = F.when(x <= c1, F.lit(p0) + (x - c0) * ((p1 - p0) / (c1 - c0))).otherwise(p)
    p = F.when(x <= KPSS_TREND[0][0], F.lit(KPSS_TREND[0][1])).when(x.isNotNull(), p)
    return g.select(*keys, "n", "stat", "lags", p.alias("p_value"), (p > alpha).alias("stationary"))


# ---------------------------------------------------------------- lagged pairs

def _offset_pairs(d: DataFrame, max_lag: int) -> DataFrame:
    """Rows (series, offset, a, x): target value at a position and candidate value
    ``offset`` rows later. ``d(series, ts, a, x)`` holds one row per position.

    Lags come from one window over the candidate, so the following aggregates by
    (series, offset) run on the partitioning that is already there."""
    w = series_window()
    cells = [F.struct(F.lit(o).alias("offset"), (F.lag("a", o) if o >= 0 else F.lead("a", -o)).over(w).alias("a"))
             for o in range(-max_lag, max_lag + 1)]
    rows = d.withColumn("_c", F.array(*cells))
    return rows.select("series", "x", F.explode("_c").alias("c")).select("series", "c.offset", "c.a", "x")


def _with_target(df: DataFrame, target: str) -> DataFrame:
    """Candidates beside the target by date; the target is one calendar long."""
    t = df.filter(F.col("series") == target).select("ts", F.col("value").alias("a"))
    return df.filter(F.col("series") != target).join(t, "ts", "left").select("series", "ts", "a", F.col("value").alias("x"))


def lag_correlation(dense: DataFrame, target: str, max_lag: int) -> DataFrame:
    """Pearson correlation of the target with every other series at offsets
    -L..L: the pair is target[i], candidate[i + offset], so a positive best
    offset means the target leads. Input is dense; missing pairs are skipped."""
    pairs = _offset_pairs(_with_target(dense, target), max_lag)
    return pairs.groupBy("series", "offset").agg(corr_guarded(F.col("a"), F.col("x")).alias("corr"))


def batch_lag_correlation(df: DataFrame, target: str, max_lag: int, convention: str = "lead") -> DataFrame:
    """Best offset per candidate after dropping dates where either side is
    missing. ``lead``: how many periods the candidate is ahead (offset < 0);
    ``raw``: positive offsets of :func:`lag_correlation` as they are."""
    d = _with_target(df, target).filter(F.col("a").isNotNull() & F.col("x").isNotNull())
    n = d.groupBy("series").agg(F.count(F.lit(1)).alias("n_points"))
    pairs = _offset_pairs(d, max_lag)
    cor = pairs.groupBy("series", "offset").agg(corr_guarded(F.col("a"), F.col("x")).alias("corr"))
    side = F.col("offset") < 0 if convention == "lead" else F.col("offset") > 0
    steps = F.abs("offset")
    best = (cor.filter(side & F.col("corr").isNotNull()).groupBy("series")
            .agg(F.max(F.struct(F.abs("corr").alias("c"), (-steps).alias("k"), F.col("corr").alias("r"))).alias("b")))
    out = n.join(best, "series", "left")
    enough = F.col("n_points") >= max_lag + 2
    return out.select(F.lit(target).alias("target"), "series", "n_points",
                      F.when(enough, -F.col("b.k")).alias("lead"), F.when(enough, F.col("b.r")).alias("corr"),
                      F.when(enough, "ok").otherwise("too_few_points").alias("note"))


def _measures(pairs: DataFrame, bins: int, alpha: float = 1e-9) -> DataFrame:
    """Correlation and D(target || candidate) over common equal-width bins per
    (series, offset), from rows (series, offset, a, x)."""
    on = ["series", "offset"]
    both = F.col("a").isNotNull() & F.col("x").isNotNull()
    a, x = F.when(both, F.col("a")), F.when(both, F.col("x"))
    span = Window.partitionBy(*on)
    p = pairs.withColumns({"a": a, "x": x}).withColumns({
        "lo": F.least(F.min("a").over(span), F.min("x").over(span)), "hi": F.greatest(F.max("a").over(span), F.max("x").over(span))})

    def bucket(v):
        i = F.floor(F.try_divide((F.col(v) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))).cast("int")
        return F.when(F.col(v).isNotNull(), F.least(F.coalesce(i, F.lit(0)), F.lit(bins - 1)))
    p = p.withColumns({"_ba": bucket("a"), "_bx": bucket("x")})
    per_bin = [F.struct(F.count_if(F.col("_ba") == i).alias("p"), F.count_if(F.col("_bx") == i).alias("q")) for i in range(bins)]
    g = p.groupBy(*on).agg(corr_guarded(F.col("a"), F.col("x")).alias("corr"), F.count("a").alias("n"),
                           F.max(F.col("hi") - F.col("lo")).alias("_spread"), F.array(*per_bin).alias("_h"))
    n, norm = F.col("n"), 1.0 + bins * alpha
    terms = F.transform("_h", lambda h: F.when(h["p"] > 0, F.try_divide(h["p"].cast("double"), n) * (
        F.ln(F.try_divide(h["p"].cast("double"), n)) - F.ln((F.try_divide(h["q"].cast("double"), n) + alpha) / norm))).otherwise(0.0))
    kl = F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    kl = F.when(F.col("n") < max(bins + 1, 3), None).when((F.col("_spread") == 0) & F.lit(bins > 1), float("inf")).otherwise(kl)
    return g.select(*on, "corr", "n", kl.alias("kl"))


def histogram_pairs(df: DataFrame, target: str, bins: int, candidates: Sequence[str] | None = None) -> DataFrame:
    """Probabilities of the target and of each candidate (default: every other series) over the
    equal-width bins the two have in common; the last bin is closed. Two constant equal series
    have no bins. The target's rows go along once per candidate."""
    live = df.filter(F.col("value").isNotNull()).select("series", "value")
    others = live.filter(F.col("series") != target if candidates is None else F.col("series").isin(list(candidates)))
    names = others.select("series").distinct().agg(F.collect_list("series")).scalar()
    both = others.select(F.col("series").alias("candidate"), "series", "value").unionByName(
        live.filter(F.col("series") == target).select(F.explode(names).alias("candidate"), "series", "value"))
    span = both.groupBy("candidate").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = both.join(span, "candidate").filter(F.lit(bins == 1) | (F.col("lo") < F.col("hi")))
    i = F.least(F.coalesce(F.floor(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(bins - 1))
    hits = d.select("candidate", "series", i.cast("int").alias("bin"), "lo", ((F.col("hi") - F.col("lo")) / F.lit(bins)).alias("width"))
    g = hits.groupBy("candidate", "series").agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.max("width").alias("width"),
                                                F.array(*[F.count_if(F.col("bin") == k) for k in range(bins)]).alias("h"))
    out = g.select("candidate", "series", "n", "lo", "width", F.posexplode("h").alias("bin", "count"))
    return out.select("candidate", "series", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "count",
                      F.try_divide(F.col("count").cast("double"), F.col("n")).alias("probability"))


def kl_pairs(dist: DataFrame, target: str, alpha: float = 1e-9) -> DataFrame:
    """D(target || candidate) per candidate, from :func:`histogram_pairs`."""
    g = dist.groupBy("candidate", "bin").agg(F.max(F.when(F.col("series") == target, F.col("probability"))).alias("p"),
                                             F.max(F.when(F.col("series") == F.col("candidate"), F.col("probability"))).alias("q"))
    g = g.select("candidate", "p", (F.col("q") + alpha).alias("q"))
    s = g.groupBy("candidate").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * (F.ln("p") - F.ln("q")))).alias("raw"), F.sum("q").alias("z"),
                                   F.sum(F.when(F.col("p") > 0, F.col("p"))).alias("mass"))
    return s.select("candidate", F.greatest(F.lit(0.0), F.coalesce(F.col("raw") + F.col("mass") * F.ln("z"), F.lit(0.0))).alias("kl"))


def histogram_distribution(df: DataFrame, a: str, b: str, bins: int) -> DataFrame:
    """:func:`histogram_pairs` of two series."""
    return histogram_pairs(df, a, bins, [b]).drop("candidate")


def kl_divergence(dist: DataFrame, a: str, b: str, alpha: float = 1e-9) -> DataFrame:
    """D(a || b) of two distributions from :func:`histogram_distribution`; 0 without bins."""
    found = kl_pairs(dist.withColumn("candidate", F.lit(b)), a, alpha)
    return found.agg(F.coalesce(F.max("kl"), F.lit(0.0)).alias("kl"))


def overlap(dense: DataFrame, target: str, lag: int) -> DataFrame:
    """Pairs target[i], candidate[i - lag] present on both sides, at least two."""
    pairs = _offset_pairs(_with_target(dense, target), abs(lag)).filter(F.col("offset") == -lag)
    pairs = pairs.filter(F.col("a").isNotNull() & F.col("x").isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    return pairs.withColumn("_n", n).filter("_n >= 2").select("series", F.col("a").alias("target_value"), F.col("x").alias("candidate_value"))


def lead_lag(dense: DataFrame, target: str, max_lag: int, bins: int) -> DataFrame:
    """Correlation and divergence per candidate with the best offset of each.

    A candidate (or target) with fewer than ``max_lag + 2`` values gets a note.
    Everything after the meeting with the target runs on one shuffle by series."""
    d = _with_target(dense, target)
    own = Window.partitionBy("series")
    d = d.withColumn("_ok", F.least(F.count("x").over(own), F.count("a").over(own)) >= max_lag + 2)
    w = series_window()
    cells = [F.struct(F.lit(o).alias("offset"), (F.lag("a", o) if o >= 0 else F.lead("a", -o)).over(w).alias("a"))
             for o in range(-max_lag, max_lag + 1)]
    pairs = d.withColumn("_c", F.array(*cells)).select("series", "_ok", "x", F.explode("_c").alias("c"))
    pairs = pairs.select("series", F.col("c.offset").alias("offset"), F.when(F.col("_ok"), F.col("c.a")).alias("a"), "x")
    both = _measures(pairs, bins)
    best = both.groupBy("series").agg(
        F.max(F.when(F.col("corr").isNotNull(), F.struct(F.abs("corr").alias("c"), (-F.col("offset")).alias("k"), F.col("corr").alias("r")))).alias("c"),
        F.min(F.when(F.col("kl").isNotNull(), F.struct("kl", (-F.col("offset")).alias("k")))).alias("d"))
    return best.select(
        F.lit(target).alias("target"), "series", (-F.col("c.k")).alias("corr_offset"), F.col("c.r").alias("corr"),
        (-F.col("d.k")).alias("kl_offset"), F.col("d.kl").alias("kl"),
        F.when(F.col("c").isNull() & F.col("d").isNull(), "insufficient_data").otherwise("ok").alias("note"))


def interpret_lead_lag(df: DataFrame, corr_threshold: float = 0.3, tolerance: int = 1) -> DataFrame:
    """Verdict and direction from agreement of the two measures. A positive
    offset means that the target moves first."""
    c_ok = F.coalesce(F.abs("corr") >= corr_threshold, F.lit(False))
    k_ok = F.coalesce(F.col("kl") != float("inf"), F.lit(False))
    agree = F.coalesce(F.abs(F.col("corr_offset") - F.col("kl_offset")) <= tolerance, F.lit(False))
    verdict = (F.when(c_ok & k_ok & agree, "strong").when(c_ok & k_ok, "mixed").when(c_ok | k_ok, "potential")
               .when(F.col("corr_offset").isNotNull() | F.col("kl_offset").isNotNull(), "weak").otherwise("none"))
    main = F.when(c_ok, F.col("corr_offset")).when(k_ok, F.col("kl_offset"))
    direction = (F.when(main > 0, "candidate_lags").when(main < 0, "candidate_leads").when(main == 0, "synchronous"))
    return df.withColumns({"verdict": verdict, "direction": direction})


# ---------------------------------------------------------------- DTW

def _dtw(a: np.ndarray, b: np.ndarray, squared: bool, radius: int | None):
    """Exact DTW, or within a Sakoe-Chiba band: (distance, i path, j path). Works along
    anti-diagonals with two of them in memory; of each cell only its step (one byte)
    is kept, and only inside the band."""
    n, m = len(a), len(b)
    width = n + m if radius is None else max(radius, abs(n - m))
    steps: list[tuple[int, np.ndarray]] = []
    before, last = (0, np.full(0, np.inf)), (0, np.full(0, np.inf))  # first i and costs of the two diagonals before

    def at(diagonal: tuple[int, np.ndarray], i: np.ndarray) -> np.ndarray:
        lo, costs = diagonal
        inside = (i >= lo) & (i < lo + len(costs))
        out = np.full(len(i), np.inf)
        out[inside] = costs[i[inside] - lo]
        return out
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1, -(-(k - width) // 2)), min(n, k + 1, (k + width) // 2 + 1))
        gap = np.abs(a[i] - b[k - i])
        come = np.stack([at(before, i - 1), at(last, i - 1), at(last, i)])
        if k == 0:
            come[:, 0] = 0.0
        step = np.argmin(come, axis=0).astype(np.int8)
        before, last = last, (int(i[0]) if len(i) else 0, (gap * gap if squared else gap) + come[step, np.arange(len(i))])
        steps.append((int(i[0]) if len(i) else 0, step))
    i, j, path = n - 1, m - 1, []
    while True:
        path.append((i, j))
        if i == 0 and j == 0:
            break
        lo, step = steps[i + j]
        move = int(step[i - lo])
        i, j = (i - 1, j - 1) if move == 0 else (i - 1, j) if move == 1 else (i, j - 1)
    return float(last[1][n - 1 - last[0]]), [p[0] for p in path[::-1]], [p[1] for p in path[::-1]]


_DTW_RESULT = StructType([StructField("distance", DoubleType()), StructField("path_i", ArrayType(IntegerType())),
                          StructField("path_j", ArrayType(IntegerType()))])


def dtw_batch(df: DataFrame, pairs: DataFrame, metric: str = "abs", radius: int | None = None) -> DataFrame:
    """DTW of all ``pairs(target, candidate)`` as one job, nearest first.

    Each series is gathered once (one calendar long), joined to the pairs, and a
    vectorised function works through the pairs of a batch. ``radius`` None is
    exact; an invalid radius counts as 10."""
    if radius is not None and radius <= 0:
        radius = 10
    squared = metric == "squared"
    vec = (df.filter(F.col("value").isNotNull()).groupBy("series")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"]).alias("v")))

    @F.pandas_udf(_DTW_RESULT)
    def solve(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = [_dtw(np.asarray(x, dtype=float), np.asarray(y, dtype=float), squared, radius)
                    if x is not None and y is not None and len(x) and len(y) else (None, None, None) for x, y in zip(a, b)]
            yield pd.DataFrame(rows, columns=["distance", "path_i", "path_j"])
    d = (pairs.join(vec.select(F.col("series").alias("target"), F.col("v").alias("_a")), "target", "left")
         .join(vec.select(F.col("series").alias("candidate"), F.col("v").alias("_b")), "candidate", "left"))
    out = spread(d, "target", "candidate").withColumn("r", solve("_a", "_b"))
    return (out.select("target", "candidate", F.col("r.distance").alias("distance"), F.col("r.path_i").alias("path_i"),
                       F.col("r.path_j").alias("path_j"),
                       F.when(F.col("r.distance").isNull(), "empty_series").otherwise("ok").alias("note"))
            .orderBy(F.col("distance").asc_nulls_last(), "target", "candidate"))


# ---------------------------------------------------------------- win rate

RANGES = {"all": None, "6m": 6, "1y": 12, "3y": 36}


def win_rate(df: DataFrame, target: str, as_of: str, ranges: Sequence[str] = tuple(RANGES)) -> DataFrame:
    """Share of the target's changes in which a series moves the same way, in
    percent, per look-back range before ``as_of``. Changes are between a series'
    own non-missing points inside the range; dates then meet."""
    start = lambda r: F.lit("0001-01-01").cast("date") if RANGES[r] is None else F.add_months(F.lit(as_of).cast("date"), -RANGES[r])
    spans = F.array(*[F.struct(F.lit(r).alias("range"), start(r).alias("from")) for r in ranges])
    d = df.filter(F.col("value").isNotNull()).select("series", "ts", "value", F.explode(spans).alias("s"))
    d = d.filter(F.col("ts") >= F.col("s.from")).select("series", "ts", "value", F.col("s.range").alias("range"))
    w = Window.partitionBy("series", "range").orderBy("ts")
    d = d.withColumn("d", F.col("value") - F.lag("value").over(w)).filter(F.col("d").isNotNull())
    t = d.filter(F.col("series") == target).select("range", "ts", F.col("d").alias("t"))
    both = d.filter(F.col("series") != target).join(t, ["range", "ts"])
    moved = F.col("t") != 0
    out = both.groupBy("series", "range").agg(
        F.count(F.lit(1)).alias("n_common"), F.count_if(moved).alias("n_changes"),
        F.count_if(moved & (F.signum("t") == F.signum("d"))).alias("n_same"))
    return out.select(F.lit(target).alias("target"), "series", "range", "n_common", "n_changes",
                      F.try_divide(F.col("n_same") * 100.0, F.col("n_changes")).alias("win_rate"))

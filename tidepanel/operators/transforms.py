"""Scalar and window transforms per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidepanel.functions.calendar import bin_label
from tidepanel.functions.scalars import nullif_zero, safe_div
from tidepanel.operators.clean import time_filter
from tidepanel.operators.panel import SERIES, series_window


def _running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def apply_transform(v: Column, kind: str, w: WindowSpec, **p) -> Column:
    """One transform of a column; positional ones count the rows of window ``w``,
    so densify first where the panel calendar matters."""
    present = lambda c: F.when(v.isNotNull(), c)
    if kind == "log":
        return F.when(v > 0, F.ln(v))
    if kind == "log10":
        return F.when(v > 0, F.log10(v))
    if kind == "exp":
        return F.exp(v)
    if kind == "abs":
        return F.abs(v)
    if kind == "cumsum":
        return present(F.sum(v).over(_running(w)))
    if kind == "cumprod":
        return present(F.product(v).over(_running(w)))
    if kind == "cummin":
        return present(F.min(v).over(_running(w)))
    if kind == "cummax":
        return present(F.max(v).over(_running(w)))
    if kind == "diff":
        return v - F.lag(v, p.get("periods", 1)).over(w)
    if kind == "moving_average":
        return F.avg(v).over(w.rowsBetween(-(p["window"] - 1), 0))
    if kind == "growth_rate":
        prev = F.lag(v, p.get("periods", 1)).over(w)
        return safe_div(v - prev, prev)
    if kind == "add":
        return v + F.lit(float(p["constant"]))
    if kind == "subtract":
        return v - F.lit(float(p["constant"]))
    if kind == "multiply":
        return v * F.lit(float(p["constant"]))
    if kind == "divide":
        return safe_div(v, F.lit(float(p["constant"])))
    raise ValueError(f"unknown transform {kind!r}")


def transform(df: DataFrame, kind: str, keys: Sequence[str] = SERIES, **p) -> DataFrame:
    return df.withColumn("value", apply_transform(F.col("value"), kind, series_window(keys), **p))


def growth_periods(freq: Column, yoy: bool = True) -> Column:
    """Rows back for a year-on-year change, by frequency code; otherwise one."""
    if not yoy:
        return F.lit(1)
    f = F.upper(freq)
    return (F.when(f.startswith("Q"), 4).when(f.startswith("M"), 12).when(f.startswith("W"), 52)
            .when(f.startswith("D") | f.startswith("B"), 365).otherwise(1))


_LABELS = {"log": "Log", "exp": "Exp", "abs": "Abs", "cumsum": "Cumsum", "cumprod": "Cumprod",
           "cummin": "Cummin", "cummax": "Cummax", "log10": "Log10"}


def derived_suffix(kind: str, yoy: bool = False, **p) -> str:
    if kind == "diff":
        return f"Diff_{p.get('periods', 1)}"
    if kind == "moving_average":
        return f"Moving Average_{p['window']}"
    if kind == "growth_rate":
        return f"{'YoY' if yoy else 'PoP'}_{p.get('periods', 1)}p"
    if kind in ("add", "subtract", "multiply", "divide"):
        return f"{ {'add': 'add', 'subtract': 'sub', 'multiply': 'mul', 'divide': 'div'}[kind]}_{p['constant']:g}"
    return _LABELS[kind]


def transform_chain(df: DataFrame, steps: Sequence[Mapping], start=None, end=None,
                    series: Sequence[str] | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """Derived series ``x_Diff_1``, ``x_YoY_12p``, … beside the originals.

    A step is ``{"kind": …, …params}``; ``"of": i`` applies it to the result of
    step ``i``. All steps are columns of one pass over the series window, then
    unfolded to rows.
    """
    d = time_filter(df, start, end)
    w = series_window(keys)
    names, labels = ["value"], [""]
    for s in steps:
        p = {k: v for k, v in s.items() if k not in ("kind", "of", "yoy")}
        src = names[s["of"] + 1] if "of" in s else "value"
        stem = labels[s["of"] + 1] if "of" in s else ""
        labels.append(f"{stem}_{derived_suffix(s['kind'], s.get('yoy', False), **p)}")
        names.append(f"_v{len(names)}")
        d = d.withColumn(names[-1], apply_transform(F.col(src), s["kind"], w, **p))
    chosen = F.lit(True) if series is None else F.col("series").isin(list(series))
    items = F.array(*[F.struct(F.lit(lab).alias("s"), F.col(n).alias("v"), F.lit(i > 0).alias("new"))
                      for i, (lab, n) in enumerate(zip(labels, names))])
    d = d.select(*keys, "ts", F.explode(F.filter(items, lambda x: ~x["new"] | chosen)).alias("e"))
    rest = [k for k in keys if k != "series"]
    return d.select(*rest, F.concat("series", "e.s").alias("series"), "ts", F.col("e.v").alias("value"))


# ---------------------------------------------------------------- formulas

def normalized_weights(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Divide by the sum, unless it is already 1 or 100, or zero."""
    total = weights.groupBy(*by).agg(F.sum("weight").alias("_s")) if by else None
    if total is None:
        d = weights.select("*", weights.agg(F.sum("weight")).scalar().alias("_s"))
    else:
        d = weights.join(total, list(by))
    keep = (F.abs(F.col("_s") - 1) < 1e-9) | (F.abs(F.col("_s") - 100) < 1e-9) | (F.col("_s") == 0)
    return d.withColumn("weight", F.when(keep, F.col("weight")).otherwise(safe_div(F.col("weight"), F.col("_s")))).drop("_s")


def weighted_sum(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Additive formulas for all labels at once: ``weights(label, series,
    weight)``; a date where any term is missing gives NULL."""
    size = weights.groupBy("label").agg(F.count(F.lit(1)).alias("_need"))
    w = weights.join(size, "label")
    return (df.join(w, "series").groupBy("label", "ts")
            .agg(F.sum(F.col("value") * F.col("weight")).alias("_sum"), F.count("value").alias("_have"),
                 F.first("_need").alias("_need"))
            .select(F.col("label").alias("series"), "ts",
                    F.when(F.col("_have") == F.col("_need"), F.col("_sum")).alias("value")))


def weighted_formula(df: DataFrame, name: str, terms: Sequence[tuple[str, str, float]],
                     normalize: bool = False) -> DataFrame:
    """``w1*x1 op w2*x2 …`` from left to right; terms are (op, series, weight),
    the first op is ignored. A zero divisor gives NULL."""
    weights = [t[2] for t in terms]
    total = sum(weights)
    if normalize and total != 0 and min(abs(total - 1), abs(total - 100)) >= 1e-9:
        weights = [x / total for x in weights]
    used = list(dict.fromkeys(t[1] for t in terms))
    wide = df.filter(F.col("series").isin(used)).groupBy("ts").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(f"_x{i}") for i, s in enumerate(used)])
    acc = None
    for (op, s, _), w in zip(terms, weights):
        x = F.col(f"_x{used.index(s)}") * F.lit(float(w))
        if acc is None:
            acc = x
        elif op == "+":
            acc = acc + x
        elif op == "-":
            acc = acc - x
        elif op == "*":
            acc = acc * x
        elif op == "/":
            acc = safe_div(acc, nullif_zero(x))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return wide.select(F.lit(name).alias("series"), "ts", acc.alias("value"))


def group_pairs(left: Sequence[str], right: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs for group arithmetic: n:n in order, or one side repeated."""
    if len(left) == len(right):
        return list(zip(left, right))
    if len(left) == 1:
        return [(left[0], r) for r in right]
    if len(right) == 1:
        return [(x, right[0]) for x in left]
    raise ValueError("group sizes must match, or one side must have one member")


def group_arithmetic(df: DataFrame, pairs: DataFrame, op: str) -> DataFrame:
    """``pairs(name, left, right)``: one derived series per pair, by date.

    Each observation goes to the pairs that name it, and the two sides of a
    pair meet in one aggregate on (pair, date)."""
    roles = pairs.select("name", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left").alias("series")),
        F.struct(F.lit("r").alias("side"), F.col("right").alias("series")))).alias("e")).select("name", "e.side", "e.series")
    both = df.join(roles, "series").groupBy("name", "ts").agg(
        F.max(F.when(F.col("side") == "l", F.col("value"))).alias("l"),
        F.max(F.when(F.col("side") == "r", F.col("value"))).alias("r"))
    value = {"+": F.col("l") + F.col("r"), "-": F.col("l") - F.col("r"), "*": F.col("l") * F.col("r"),
             "/": safe_div(F.col("l"), F.col("r"))}[op]
    return both.select(F.col("name").alias("series"), "ts", value.alias("value"))


def within_period(df: DataFrame, period: str, kind: str, keys: Sequence[str] = SERIES, **p) -> DataFrame:
    """sum, prod, min, max (to date), diff or rolling mean inside each year,
    quarter, month or week (``A Q M W``)."""
    rule = {"Y": "A", "A": "A", "Q": "Q", "M": "M", "W": "W-SUN"}[period]
    d = df.withColumn("_p", bin_label(F.col("ts"), rule))
    w = Window.partitionBy(*keys, "_p").orderBy("ts")
    names = {"sum": "cumsum", "prod": "cumprod", "min": "cummin", "max": "cummax", "diff": "diff",
             "rolling": "moving_average"}
    return d.withColumn("value", apply_transform(F.col("value"), names[kind], w, **p)).drop("_p")


def base_year_growth(df: DataFrame, base_year: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """Growth of annual data against one chosen year."""
    base = F.max(F.when(F.year("ts") == base_year, F.col("value"))).over(Window.partitionBy(*keys))
    return df.withColumn("value", safe_div(F.col("value") - base, base))


# ---------------------------------------------------------------- model scaling

def standardise(df: DataFrame, zero_std: str = "one", keys: Sequence[str] = SERIES) -> DataFrame:
    """(x - mean) / std per series; a constant series keeps std 1 or is dropped."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({"mean": F.avg("value").over(w), "std": F.stddev_samp("value").over(w)})
    if zero_std == "drop":
        d = d.filter(F.col("std") > 0)
    else:
        d = d.withColumn("std", F.when(F.coalesce("std", F.lit(0.0)) > 0, F.col("std")).otherwise(F.lit(1.0)))
    return d.withColumn("z", safe_div(F.col("value") - F.col("mean"), F.col("std")))


def rescale(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def mask_months(df: DataFrame, target: str, months: Sequence[int] = (1, 2)) -> DataFrame:
    hide = (F.col("series") == target) & F.month("ts").isin(list(months))
    return df.withColumn("value", F.when(~hide, F.col("value")))


def apply_rules(df: DataFrame, rules: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Per-series ``rules(series, status)``: level, diff or log_diff; log_diff
    falls back to diff when a value is not positive, other statuses keep the level."""
    w = series_window(keys)
    low = F.min("value").over(Window.partitionBy(*keys))
    v = F.col("value")
    d = df.join(rules.select("series", "status"), "series", "left").withColumn("_low", low)
    diff = v - F.lag(v).over(w)
    lv = F.when(v > 0, F.ln(v))
    log_diff = lv - F.lag(lv).over(w)
    out = (F.when((F.col("status") == "log_diff") & (F.col("_low") > 0), log_diff)
           .when(F.col("status").isin("diff", "log_diff"), diff).otherwise(v))
    return d.withColumn("value", out).drop("_low", "status")

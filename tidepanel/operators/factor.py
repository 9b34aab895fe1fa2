"""Dynamic factor model as an iterative Spark job.

Many models (candidate variable sets, vintages) run side by side: every table
carries a ``panel`` key. Observations stay distributed by series. One EM
iteration has two aggregates:

* over series, per (panel, date): the information matrix and vector of the
  measurement equation, ``J = sum l l'/r`` and ``h = sum l y/r``;
* over dates, per (panel, series): the cross-products for loadings and noise.

What is left per panel is a scan over dates with k-by-k matrices, k being the
number of factors and the dates one calendar, so a group is small by
construction.

:func:`fit_dfm` gathers each series once as arrays over its dates. An iteration
then reads these rows where they lie: the factors (dates by k, small enough for
Spark to broadcast) meet a row, give its loadings, and the row's share of J and h
is added up inside the task. What is shuffled is one row per task and date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidepanel.functions.calendar import bin_ordinal
from tidepanel.operators.transforms import mask_months
from tidepanel.plans.session import cut_lineage, discard, spread

# Numeric guards of the estimation.
STATE_JITTER = 1e-6
INNOVATION_JITTER = 1e-4
RIDGE = 1e-7
NOISE_FLOOR = 1e-7
INITIAL_FLOOR = 1e-6
FIRST_STAGE_CAP = 10  # what the first estimate of a two-stage tuning allows, see select_k
DEFAULT_ITERATIONS = 30
SELECTION_TOLERANCE = 0.01  # change of the parameters at which a candidate's fit ends
BUCKET_VALUES = 100_000  # observations that meet a round's candidate models in one group

VEC = "array<double>"


# ---------------------------------------------------------------- model panel

def model_panel(obs: DataFrame, rule: str = "W-FRI") -> DataFrame:
    """(panel, series, ts, t, y, mean, std, z, n_t): centred and standardised
    observations with their position on the panel's calendar. Dates are
    positions by arithmetic, so a date without observations still counts."""
    w = Window.partitionBy("panel", "series")
    live = obs.filter(F.col("value").isNotNull())
    pos = bin_ordinal(F.col("ts"), rule)
    span = obs.groupBy("panel").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    std = F.stddev_samp("value").over(w)
    d = live.withColumns({"mean": F.avg("value").over(w), "std": F.when(F.coalesce(std, F.lit(0.0)) > 0, std).otherwise(1.0)})
    d = d.join(span, "panel").withColumn("y", F.col("value") - F.col("mean"))
    return d.select("panel", "series", "ts", (pos - F.col("_lo")).alias("t"), "value", "y", "mean", "std",
                    F.try_divide("y", "std").alias("z"), (F.col("_hi") - F.col("_lo") + 1).alias("n_t"))


# ---------------------------------------------------------------- principal components

def time_gram(m: DataFrame, flush: int = 64_000_000) -> DataFrame:
    """(panel, i, row): Gram matrix over dates of the zero-filled standardised
    panel. Partitions hold whole series and add up their own dates-by-dates
    block (written out early when it grows); rows of equal number are summed
    afterwards. Nothing has the size of the series dimension."""
    vec = spread(m, "panel", "series").groupBy("panel", "series").agg(F.max("n_t").alias("n_t"), F.collect_list("t").alias("t"), F.collect_list("z").alias("z"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def out():
            for panel, g in sums.items():
                yield pd.DataFrame({"panel": panel, "i": np.arange(len(g)), "row": list(g)})
        for pdf in batches:
            for panel, part in pdf.groupby("panel"):
                n = int(part["n_t"].iloc[0])
                block = np.zeros((len(part), n))
                for r, (t, z) in enumerate(zip(part["t"], part["z"])):
                    block[r, np.asarray(t, dtype=int)] = z
                g = block.T @ block
                sums[panel] = sums[panel] + g if panel in sums else g
            if sum(g.size for g in sums.values()) > flush:
                yield from out()
                sums.clear()
        yield from out()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at = np.unique(pdf["i"].to_numpy(), return_inverse=True)
        total = np.zeros((len(rows), len(pdf["row"].iloc[0])))
        np.add.at(total, at, np.vstack(pdf["row"].to_list()))
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "i": rows, "row": list(total)})
    schema = f"panel string, i long, row {VEC}"
    parts = vec.select("panel", "n_t", "t", "z").mapInPandas(partial, schema)
    # sixteen neighbouring rows per group: few Python calls, small groups
    return parts.groupBy("panel", F.floor(F.col("i") / 16)).applyInPandas(add, schema)


def _eigen(gram: DataFrame, k: int | None) -> DataFrame:
    """Per panel: eigenvalues (t = -1, all of them) and the first k factor scores
    per date, signed so that the largest entry is positive."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.vstack(pdf.sort_values("i")["row"].to_list())
        val, u = np.linalg.eigh((g + g.T) / 2)
        order = np.argsort(val)[::-1]
        val, u = np.maximum(val[order], 0.0), u[:, order]
        kk = min(k or 0, len(val))
        f = u[:, :kk] * np.sqrt(val[:kk])
        if kk:
            f = f * np.where(f[np.abs(f).argmax(axis=0), np.arange(kk)] < 0, -1.0, 1.0)
        panel = pdf["panel"].iloc[0]
        rows = [(panel, -1, val.tolist())] + [(panel, i, f[i].tolist()) for i in range(len(f) if kk else 0)]
        return pd.DataFrame(rows, columns=["panel", "t", "f"])
    return gram.groupBy("panel").applyInPandas(one, f"panel string, t int, f {VEC}")


def pca_variance(obs: DataFrame, n_components: int | None = None, rule: str = "W-FRI") -> DataFrame:
    """Explained and cumulative variance (percent) and eigenvalues of the
    standardised panel, missing values at the mean; all components unless
    ``n_components`` asks for the first ones."""
    m = cut_lineage(model_panel(cut_lineage(obs), rule))
    eig = _eigen(time_gram(m), None)
    size = m.groupBy("panel").agg(F.max("n_t").alias("n_t"), F.count_distinct("series").alias("n_series"))
    d = eig.filter("t = -1").join(size, "panel")
    total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
    d = d.select("panel", "n_series", "n_t", total.alias("_total"), F.posexplode("f").alias("_i", "_v"))
    d = d.filter(F.col("_i") < F.least(F.col("n_series"), F.col("n_t"), *([] if n_components is None else [F.lit(n_components)])))
    w = Window.partitionBy("panel").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    share = F.try_divide(F.col("_v") * 100.0, F.col("_total"))
    return d.select("panel", (F.col("_i") + 1).alias("k"), share.alias("explained_pct"), F.sum(share).over(w).alias("cumulative_pct"),
                    F.try_divide(F.col("_v"), F.col("n_t") - 1.0).alias("eigenvalue"),
                    F.try_divide(F.col("_total"), F.col("n_t") - 1.0).alias("total_variance"), "n_series", "n_t")


def select_k(pca: DataFrame, method: str = "bai_ng", threshold: float | None = None, loadings: DataFrame | None = None,
             target: str | None = None, cap: int | None = None) -> DataFrame:
    """Number of factors per panel: ``cumulative`` (share reached), ``elbow``
    (relative drop below), ``kaiser`` (eigenvalue above one), ``common`` (share of
    the target's squared loadings reached) or ``bai_ng``. With ``cap`` (the first
    stage of a tuning uses ``FIRST_STAGE_CAP``) a column ``capped`` says where the
    limit took effect."""
    by_k = Window.partitionBy("panel").orderBy("k")
    d = pca
    if method == "common":
        sq = loadings.filter(F.col("series") == target).select("panel", F.posexplode("l").alias("_i", "_l"))
        d = sq.select("panel", (F.col("_i") + 1).alias("k"), (F.col("_l") * F.col("_l")).alias("_s"))
        cum = F.try_divide(F.sum("_s").over(by_k.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_s").over(Window.partitionBy("panel")))
        d = d.withColumn("_ok", cum >= (0.8 if threshold is None else threshold))
    elif method == "cumulative":
        d = d.withColumn("_ok", F.col("cumulative_pct") >= (0.9 if threshold is None else threshold) * 100)
    elif method == "elbow":
        drop = F.abs(F.try_divide(F.lead("eigenvalue").over(by_k) - F.col("eigenvalue"), F.col("eigenvalue")))
        d = d.withColumn("_ok", drop < (0.1 if threshold is None else threshold))
    if method == "kaiser":
        out = d.groupBy("panel").agg(F.greatest(F.count_if(F.col("eigenvalue") > (1.0 if threshold is None else threshold)), F.lit(1)).alias("k"))
    elif method == "bai_ng":
        rest = F.col("total_variance") - F.sum("eigenvalue").over(by_k.rowsBetween(Window.unboundedPreceding, 0))
        n, t = F.col("n_series").cast("double"), F.col("n_t").cast("double")
        ssr = F.when(F.col("k") < F.least(F.col("n_series"), F.col("n_t")), t * rest)
        ic = F.when(ssr > 1e-9, F.ln(ssr / (n * t)) + F.col("k") * (n + t) / (n * t) * F.ln(F.least(n, t)))
        d = d.withColumn("_ic", ic)
        out = d.groupBy("panel").agg(F.coalesce(F.min(F.when(F.col("_ic").isNotNull(), F.struct("_ic", "k"))).getField("k"), F.lit(1)).alias("k"))
    else:
        out = d.groupBy("panel").agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("k"))), F.max("k")).alias("k"))
    return out if cap is None else out.select("panel", F.least("k", F.lit(cap)).alias("k"), (F.col("k") > cap).alias("capped"))


# ---------------------------------------------------------------- per-panel scan

def _unflat(v, k: int) -> np.ndarray:
    return np.asarray(v, dtype=float).reshape(k, k)


def _upper(v, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    iu = np.triu_indices(k)
    m[iu] = v
    return m + np.triu(m, 1).T


_SCAN = f"panel string, t int, xs {VEC}, xf {VEC}, xm {VEC}, p {VEC}, n_t int, f {VEC}, moved double"
_STATE = f"panel string, n_t int, a {VEC}, q {VEC}, x0 {VEC}, p0 {VEC}"


def _scan_panel(k: int):
    """Filter and smoother over the dates of one panel, and the state part of
    the M-step. Row t = -1 carries the new A, Q, x0 and P0, all smoothed factors as
    one array ``f``, and how far A and Q (relative to its largest entry) moved."""

    def run(info: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        n, a, q = int(s["n_t"]), _unflat(s["a"], k), _unflat(s["q"], k)
        eye = np.eye(k)
        jt, ht = [None] * n, [None] * n
        for t, j, h in zip(info["t"], info["j"], info["h"]):
            jt[int(t)], ht[int(t)] = _upper(j, k), np.asarray(h, dtype=float)
        x, xm = np.zeros((n, k)), np.zeros((n, k))
        p, pm = np.zeros((n, k, k)), np.zeros((n, k, k))
        x[0] = xm[0] = np.asarray(s["x0"], dtype=float)
        p[0] = pm[0] = _unflat(s["p0"], k)
        for t in range(1, n):  # the first date only carries the initial state
            xm[t] = a @ x[t - 1]
            pm[t] = a @ p[t - 1] @ a.T + q + STATE_JITTER * eye
            x[t], p[t] = xm[t], pm[t]
            if jt[t] is not None:
                post = np.linalg.solve(eye + pm[t] @ jt[t], pm[t])
                p[t] = (post + post.T) / 2
                x[t] = xm[t] + p[t] @ (ht[t] - jt[t] @ xm[t])
        xs, ps0 = x.copy(), p[n - 1]
        for t in range(n - 2, -1, -1):
            gain = np.linalg.solve(pm[t + 1].T, (p[t] @ a.T).T).T
            xs[t] = x[t] + gain @ (xs[t + 1] - xm[t + 1])
            ps0 = p[t] + gain @ (ps0 - pm[t + 1]) @ gain.T
        now, past = xs[1:], xs[:-1]
        a_new = now.T @ past @ np.linalg.pinv(past.T @ past + RIDGE * eye)
        cov = (now.T @ now - a_new @ (past.T @ past) @ a_new.T) / max(n - 1, 1)
        val, vec = np.linalg.eigh((cov + cov.T) / 2)
        q_new = (vec * np.maximum(val, NOISE_FLOOR)) @ vec.T
        panel = s["panel"]
        moved = max(np.abs(a_new - a).max(), np.abs(q_new - q).max() / max(np.abs(q).max(), NOISE_FLOOR))
        rows = [(panel, -1, a_new.ravel().tolist(), q_new.ravel().tolist(), xs[0].tolist(), ps0.ravel().tolist(), n, xs.ravel().tolist(), moved)]
        rows += [(panel, t, xs[t].tolist(), x[t].tolist(), xm[t].tolist(), p[t].ravel().tolist(), n, None, None) for t in range(n)]
        return pd.DataFrame(rows, columns=["panel", "t", "xs", "xf", "xm", "p", "n_t", "f", "moved"])
    return run


def information(m: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """(panel, t, j, h): measurement information per date, summed over the series
    observed there (map-side first)."""
    use = loadings.filter(F.col("l").isNotNull()).select("panel", "series", "l", (F.col("r") + INNOVATION_JITTER).alias("_r"))
    d = m.select("panel", "series", "t", "y").join(use, ["panel", "series"])
    l = [F.get("l", F.lit(i)) for i in range(k)]
    j = [F.sum(F.try_divide(l[a] * l[b], F.col("_r"))) for a in range(k) for b in range(a, k)]
    h = [F.sum(F.try_divide(l[a] * F.col("y"), F.col("_r"))) for a in range(k)]
    return d.groupBy("panel", "t").agg(F.array(*j).alias("j"), F.array(*h).alias("h"))


def kalman_smoother(m: DataFrame, loadings: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """(panel, t, xs, xf, xm, p): smoothed, filtered and predicted states and the
    filtered covariance per date; row t = -1 holds the next A, Q, x0, P0."""
    return _scan(information(m, loadings, k), state, k)


def _scan(info: DataFrame, state: DataFrame, k: int, panels: int | None = None) -> DataFrame:
    """``panels``: their number, where it is known."""
    own = state.select(*[F.col(c).alias(c) for c in state.columns])  # fresh names: both sides may stem from m
    info, own = (spread(d, "panel", groups=panels).groupBy("panel") for d in (info, own))
    return info.cogroup(own).applyInPandas(_scan_panel(k), _SCAN)


# ---------------------------------------------------------------- loadings

_LOADING = StructType([StructField("l", ArrayType(DoubleType())), StructField("r", DoubleType())])


def _regress(n: int, s: np.ndarray, b: np.ndarray, f: np.ndarray, y: float, yy: float) -> tuple:
    """Loading and noise of one series from its cross-products with the factors;
    at most k points give nothing."""
    if n <= len(b):
        return None, None
    l = np.linalg.pinv(s, hermitian=True) @ b
    e = (y - l @ f) / n
    var = (yy - 2 * l @ b + l @ s @ l) / n - e * e
    return l, float(max(var, NOISE_FLOOR))


def _loading_solver(k: int):
    @F.pandas_udf(_LOADING)
    def solve(n: pd.Series, ff: pd.Series, fy: pd.Series, f: pd.Series, y: pd.Series, yy: pd.Series) -> pd.DataFrame:
        rows = []
        for n_, ff_, fy_, f_, y_, yy_ in zip(n, ff, fy, f, y, yy):
            l, r = _regress(n_, _upper(ff_, k), np.asarray(fy_, dtype=float), np.asarray(f_, dtype=float), y_, yy_)
            rows.append((None if l is None else l.tolist(), r))
        return pd.DataFrame(rows, columns=["l", "r"])
    return solve


def factor_products(m: DataFrame, factors: DataFrame, k: int, value: str = "y", keys: Sequence[str] = ("panel", "series")) -> DataFrame:
    """Cross-products of each series with the factors over its observed dates:
    n, ff (upper triangle), fy, f, y, yy. ``factors(panel, t, f)``."""
    d = m.join(factors.select("panel", "t", "f"), ["panel", "t"])
    f, y = [F.get("f", F.lit(i)) for i in range(k)], F.col(value)
    return d.groupBy(*keys).agg(
        F.count(y).alias("n"), F.array(*[F.sum(f[a] * f[b]) for a in range(k) for b in range(a, k)]).alias("ff"),
        F.array(*[F.sum(x * y) for x in f]).alias("fy"), F.array(*[F.sum(x) for x in f]).alias("f"),
        F.sum(y).alias("y"), F.sum(y * y).alias("yy"), *[F.first(c).alias(c) for c in ("mean", "std", "n_t") if c in m.columns])


def solve_loadings(products: DataFrame, k: int) -> DataFrame:
    """Regression through the origin per series; at most k points give NULL."""
    s = _loading_solver(k)("n", "ff", "fy", "f", "y", "yy")
    keep = [c for c in ("panel", "series", "mean", "std") if c in products.columns]
    return products.withColumn("_s", s).select(*keep, F.col("_s.l").alias("l"), F.col("_s.r").alias("r"))


# ---------------------------------------------------------------- initial values and EM

def init_factors(m: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(factors, loadings, state): principal-component scores, loadings on them,
    a first-order autoregression with constant, and noise from the residuals."""
    eig = cut_lineage(_eigen(time_gram(m), k))
    factors = eig.filter("t >= 0")
    prod = factor_products(m, factors, k)
    lam = F.transform(F.slice(F.col("_val"), 1, k), lambda x: x)
    prod = prod.join(eig.filter("t = -1").select("panel", F.col("f").alias("_val")), "panel")
    load = solve_loadings(prod, k)
    # residual of the zero-filled standardised series: sum z^2 - sum (f'z)^2 / s^2
    fz = F.transform("fy", lambda x: F.try_divide(x, F.col("std")))
    fit = F.aggregate(F.zip_with(fz, lam, lambda a, s: F.when(s > 0, a * a / s).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
    psi = F.try_divide(F.try_divide("yy", F.col("std") * F.col("std")) - fit, F.col("n_t").cast("double"))
    mean_gap = prod.join(factors.groupBy("panel").agg(F.array(*[F.sum(F.get("f", F.lit(i))) for i in range(k)]).alias("_fsum")), "panel")
    fitted_sum = F.aggregate(F.zip_with(F.zip_with(fz, lam, lambda a, s: F.when(s > 0, a / s).otherwise(0.0)), F.col("_fsum"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    shift = F.try_divide(F.try_divide("y", "std") - fitted_sum, F.col("n_t").cast("double"))
    noise = mean_gap.select("panel", "series", F.greatest((psi - shift * shift) * F.col("std") * F.col("std"), F.lit(INITIAL_FLOOR)).alias("r"))
    load = load.drop("r").join(noise, ["panel", "series"])

    def var1(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.vstack(pdf.sort_values("t")["f"].to_list())
        x = np.column_stack([np.ones(len(f) - 1), f[:-1]])
        beta, *_ = np.linalg.lstsq(x, f[1:], rcond=None)
        res = f[1:] - x @ beta
        q = np.diag(np.maximum(np.atleast_1d(np.var(res, axis=0, ddof=1)), INITIAL_FLOOR))
        return pd.DataFrame([(pdf["panel"].iloc[0], len(f), beta[1:].T.ravel().tolist(), q.ravel().tolist(), [0.0] * k, np.eye(k).ravel().tolist())],
                            columns=["panel", "n_t", "a", "q", "x0", "p0"])
    return factors, load, factors.groupBy("panel").applyInPandas(var1, _STATE)


def next_state(scan: DataFrame) -> DataFrame:
    return scan.filter("t = -1").select("panel", "n_t", F.col("xs").alias("a"), F.col("xf").alias("q"), F.col("xm").alias("x0"), F.col("p").alias("p0"))


def series_rows(m: DataFrame) -> DataFrame:
    """(panel, series, mean, std, n_t, t, y): one row per series, its observations
    as arrays by date; a series is never longer than the calendar."""
    obs = F.array_sort(F.collect_list(F.struct("t", "y")))
    d = m.groupBy("panel", "series").agg(F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("n_t").alias("n_t"), obs.alias("o"))
    return d.select("panel", "series", "mean", "std", "n_t", F.col("o.t").alias("t"), F.col("o.y").alias("y"))


def _factor_rows(scan: DataFrame) -> DataFrame:
    """(panel, f): the smoothed factors of a panel, dates by k in one array."""
    return scan.filter("t = -1").select("panel", "f")


def _loading_of(t, y, f, k: int) -> tuple:
    x, y = np.asarray(f, dtype=float).reshape(-1, k)[np.asarray(t, dtype=int)], np.asarray(y, dtype=float)
    return _regress(len(y), x.T @ x, x.T @ y, x.sum(axis=0), y.sum(), y @ y)


def rows_loadings(rows: DataFrame, scan: DataFrame, k: int) -> DataFrame:
    """M step: (panel, series, mean, std, l, r) from gathered series and a scan."""
    @F.pandas_udf(_LOADING)
    def solve(t: pd.Series, y: pd.Series, f: pd.Series) -> pd.DataFrame:
        got = [_loading_of(*x, k) for x in zip(t, y, f)]
        return pd.DataFrame([(None if l is None else l.tolist(), r) for l, r in got], columns=["l", "r"])
    d = rows.join(_factor_rows(scan), "panel").withColumn("_s", solve("t", "y", "f"))
    return d.select("panel", "series", "mean", "std", F.col("_s.l").alias("l"), F.col("_s.r").alias("r"))


def rows_information(rows: DataFrame, k: int, scan: DataFrame | None = None, loadings: DataFrame | None = None, flush: int = 4_000_000) -> DataFrame:
    """(panel, t, j, h) from gathered series: with given ``loadings``, or with those
    that the factors of ``scan`` imply. Tasks add up their own series first."""
    if scan is not None:
        d = rows.join(_factor_rows(scan), "panel").select("panel", "n_t", "t", "y", "f", F.lit(None).cast(VEC).alias("l"), F.lit(None).cast("double").alias("r"))
    else:
        d = rows.join(loadings.select("panel", "series", "l", "r"), ["panel", "series"]).select("panel", "n_t", "t", "y", F.lit(None).cast(VEC).alias("f"), "l", "r")
    iu = np.triu_indices(k)
    width = len(iu[0]) + k
    names = [f"c{i}" for i in range(width)]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for panel, (total, seen) in sums.items():
                at = np.flatnonzero(seen)
                yield pd.DataFrame(total[at], columns=names).assign(panel=panel, t=at.astype(np.int32))[["panel", "t", *names]]
            sums.clear()
        for pdf in batches:
            for panel, n_t, t, y, f, l, r in pdf.itertuples(index=False):
                l, r = (None if l is None else np.asarray(l, dtype=float), r) if f is None else _loading_of(t, y, f, k)
                if l is None:
                    continue
                if panel not in sums:
                    sums[panel] = np.zeros((int(n_t), width)), np.zeros(int(n_t), bool)
                total, seen = sums[panel]
                t, y, w = np.asarray(t, dtype=int), np.asarray(y, dtype=float), r + INNOVATION_JITTER
                total[t, :len(iu[0])] += np.outer(l, l)[iu] / w
                total[t, len(iu[0]):] += y[:, None] * (l / w)
                seen[t] = True
            if sum(x.size for x, _ in sums.values()) > flush:
                yield from out()
        yield from out()
    part = d.mapInPandas(add_up, "panel string, t int, " + ", ".join(f"{c} double" for c in names))
    cols = [F.sum(c) for c in names]
    return part.groupBy("panel", "t").agg(F.array(*cols[:len(iu[0])]).alias("j"), F.array(*cols[len(iu[0]):]).alias("h"))


def fit_dfm(obs: DataFrame, k: int, n_iter: int = DEFAULT_ITERATIONS, rule: str = "W-FRI") -> dict[str, DataFrame]:
    """Fit every panel of ``obs(panel, series, ts, value)``; runs one job per
    iteration when called.

    Returns ``panel`` (the model observations), ``loadings(panel, series, l, r,
    mean, std)``, ``state(panel, n_t, a, q, x0, p0)``, ``smoothed(panel, ts, t,
    f)`` of the last E-step, the same as ``factors(panel, f)`` in one array, and ``filtered(panel, ts, t, x, x_minus, p)`` with
    the final parameters. An iteration writes its scan and then removes the one
    before it."""
    m = cut_lineage(model_panel(cut_lineage(obs), rule))
    _, load, state = init_factors(m, k)
    load, rows, state = cut_lineage(load), cut_lineage(series_rows(m)), cut_lineage(state)
    panels = state.count()
    scan = None
    for i in range(n_iter):
        info = rows_information(rows, k, loadings=load) if scan is None else rows_information(rows, k, scan=scan)
        new = cut_lineage(_scan(info, state, k, panels))
        if scan is not None:
            discard(scan)
        scan, state = new, next_state(new)
    if scan is not None:
        load = cut_lineage(rows_loadings(rows, scan, k))
    last = cut_lineage(_scan(rows_information(rows, k, loadings=load), state, k, panels))
    stamps = _stamps(m, rule)
    smooth = (scan if scan is not None else last).filter("t >= 0").select("panel", "t", F.col("xs").alias("f")).join(stamps, ["panel", "t"])
    filt = last.filter("t >= 0").select("panel", "t", F.col("xf").alias("x"), F.col("xm").alias("x_minus"), "p").join(stamps, ["panel", "t"])
    return {"panel": m, "loadings": load, "state": state, "smoothed": smooth, "filtered": filt, "factors": _factor_rows(scan if scan is not None else last)}


def _stamps(m: DataFrame, rule: str) -> DataFrame:
    """(panel, t, ts) for every position, also those without observations."""
    from tidepanel.functions.calendar import bin_label, bin_sequence

    span = m.groupBy("panel").agg(F.min(F.struct("t", "ts")).alias("a"), F.max("n_t").alias("n"))
    first = bin_label(F.col("a.ts"), rule)
    d = span.select("panel", first.alias("_first"), F.col("a.t").alias("_t0"), "n")
    d = d.withColumn("_last", _shift(F.col("_first"), rule, F.col("n") - 1 - F.col("_t0")))
    return d.select("panel", F.posexplode(bin_sequence(_shift(F.col("_first"), rule, -F.col("_t0")), F.col("_last"), rule)).alias("t", "ts"))


def _shift(label: Column, rule: str, n: Column) -> Column:
    if rule.startswith("W"):
        return F.date_add(label, (n * 7).cast("int"))
    if rule == "D":
        return F.date_add(label, n.cast("int"))
    months = {"M": 1, "Q": 3, "A": 12}[rule]
    return F.last_day(F.add_months(F.trunc(label, "MM"), (n * months).cast("int")))


# ---------------------------------------------------------------- using a fitted model

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def reconstruct(factors: DataFrame, loadings: DataFrame, rescaled: bool = True, buckets: int = 64) -> DataFrame:
    """(panel, series, ts, value): factors times loadings plus the series' mean.
    The factors are repeated per bucket of series, so one panel's series spread
    over ``buckets`` keys."""
    load = loadings.filter(F.col("l").isNotNull()).withColumn("_b", F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int"))
    d = factors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(load, ["panel", "_b"])
    fit = dot(F.col("f"), F.col("l"))
    return d.select("panel", "series", "ts", (fit + F.col("mean") if rescaled else fit).alias("value"))


def nowcast_series(model: dict[str, DataFrame], target: str, mean: float | None = None, std: float | None = None) -> DataFrame:
    """(panel, ts, value): the target implied by the smoothed factors."""
    l = model["loadings"].filter((F.col("series") == target) & F.col("l").isNotNull())
    d = model["smoothed"].join(l.select("panel", "l", "mean"), "panel")
    fit = dot(F.col("f"), F.col("l"))
    out = fit + F.col("mean") if mean is None else fit * F.lit(float(std)) + F.lit(float(mean))
    return d.select("panel", "ts", out.alias("value"))


def _standardised(obs: DataFrame, target: str, fit_end: str, oos_end: str) -> tuple[DataFrame, DataFrame]:
    """Observations up to ``oos_end``, standardised on those up to ``fit_end``, without the target's
    January and February; and the scale (panel, series, _m, _s)."""
    upto = lambda day: F.col("ts") <= F.lit(day).cast("date")
    scale = (obs.filter(upto(fit_end)).groupBy("panel", "series")
             .agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")).filter(F.col("_s") > 0))
    z = obs.filter(upto(oos_end)).join(scale, ["panel", "series"])
    z = z.withColumn("value", (F.col("value") - F.col("_m")) / F.col("_s")).select("panel", "series", "ts", "value")
    return cut_lineage(mask_months(z, target).filter(F.col("value").isNotNull())), scale


def evaluate_models(obs: DataFrame, target: str, k: int, train_end: str, oos_start: str, oos_end: str,
                    n_iter: int = DEFAULT_ITERATIONS, fit_end: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(metrics per panel, model): standardise on the data up to ``fit_end``
    (default: end of validation), hide the target in January and February, fit,
    nowcast and score every panel at once. With an earlier ``fit_end`` the later
    data only pass the filter with fixed parameters."""
    from tidepanel.operators.nowcast import nowcast_metrics

    obs = cut_lineage(obs)
    upto = lambda day: F.col("ts") <= F.lit(day).cast("date")
    z, scale = _standardised(obs, target, fit_end or oos_end, oos_end)
    model = fit_dfm(z if fit_end is None else z.filter(upto(fit_end)), k, n_iter)
    smooth = model["smoothed"]
    if fit_end is not None:
        m = model_panel(z).drop("mean", "std", "y", "z").join(model["loadings"].select("panel", "series", "mean"), ["panel", "series"])
        m = cut_lineage(m.withColumn("y", F.col("value") - F.col("mean")))
        size = m.groupBy("panel").agg(F.max("n_t").alias("n_t"))
        state = model["state"].drop("n_t").join(size, "panel").select("panel", "n_t", "a", "q", "x0", "p0")
        scan = cut_lineage(kalman_smoother(m, model["loadings"], state, k))
        smooth = scan.filter("t >= 0").select("panel", "t", F.col("xs").alias("f")).join(_stamps(m, "W-FRI"), ["panel", "t"])
    l = model["loadings"].filter((F.col("series") == target) & F.col("l").isNotNull()).select("panel", "l")
    own = scale.filter(F.col("series") == target).select("panel", "_m", "_s")
    now = (smooth.join(l, "panel").join(own, "panel")
           .select("panel", "ts", (dot(F.col("f"), F.col("l")) * F.col("_s") + F.col("_m")).alias("value")))
    goal = obs.filter(F.col("series") == target).select("panel", "ts", "value")
    return nowcast_metrics(now, goal, train_end, oos_start, oos_end), model


def _scores(metrics: DataFrame) -> dict[str, tuple[float, float]]:
    """Panel -> (mean hit rate, -mean RMSE); one short row per candidate."""
    out = {}
    for r in metrics.collect():
        hit = [x for x in (r["is_hit_rate"], r["oos_hit_rate"]) if x is not None]
        rmse = [x for x in (r["is_rmse"], r["oos_rmse"]) if x is not None]
        if hit and rmse:
            out[r["panel"]] = (sum(hit) / len(hit), -sum(rmse) / len(rmse))
    return out


# ---------------------------------------------------------------- selection

def _weighted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings (models, k), noise and whether there are any, of one series ``y`` on the factors
    ``x`` (models, dates, k) of many models: :func:`_regress` for all of them at once."""
    c, n, k = x.shape
    if n <= k:
        return np.zeros((c, k)), np.ones(c), False
    s, b = np.einsum("cni,cnj->cij", x, x), np.einsum("cni,n->ci", x, y)
    l = np.einsum("cij,cj->ci", np.linalg.pinv(s, hermitian=True), b)
    e = (y.sum() - np.einsum("ci,ci->c", l, x.sum(axis=1))) / n
    var = (y @ y - 2 * np.einsum("ci,ci->c", l, b) + np.einsum("ci,cij,cj->c", l, s, l)) / n - e * e
    return l, np.maximum(var, NOISE_FLOOR), True


def shared_information(rows: DataFrame, factors: DataFrame, k: int, without: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(panel, t, j, h) of many models over the same gathered series, which are read once and not
    copied per model. ``factors(panel, f)``, dates by k in one array: a model named like a series
    goes without it.

    With ``without``, ``factors`` hold one parent model and the result has one model per name: the
    parent's sums minus that series' own share (downdating), so a whole round of candidates costs one
    pass. ``rows`` carry a bucket ``_b`` below ``buckets`` (default: the shuffle partitions); the factors
    reach each bucket once."""
    iu = np.triu_indices(k)
    names = [f"c{i}" for i in range(len(iu[0]) + k)]
    less = None if without is None else set(without)

    def add_up(mine: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or models.empty:
            return pd.DataFrame({"panel": pd.Series(dtype=str), "t": pd.Series(dtype="int32"), **{c: pd.Series(dtype=float) for c in names}})
        panels, code = np.unique(models["panel"].to_numpy().astype(str), return_inverse=True)
        f = np.stack([np.asarray(x, dtype=float).reshape(-1, k) for x in models["f"]])[np.argsort(code)]
        n_t = f.shape[1]
        total, seen = np.zeros((len(panels), n_t, len(names))), np.zeros((len(panels), n_t), bool)
        out = []
        for series, t, y in zip(mine["series"], mine["t"], mine["y"]):
            t, y = np.asarray(t, dtype=int), np.asarray(y, dtype=float)
            l, r, any_ = _weighted(f[:, t], y)
            if not any_:
                continue
            w = r + INNOVATION_JITTER
            share = np.concatenate([np.broadcast_to((l[:, iu[0]] * l[:, iu[1]] / w[:, None])[:, None], (len(panels), len(t), len(iu[0]))),
                                    y[None, :, None] * (l / w[:, None])[:, None]], axis=2)
            use = np.flatnonzero(panels != series) if less is None else np.arange(len(panels))
            total[use[:, None], t] += share[use]
            seen[use[:, None], t] = True
            if less is not None and series in less:
                out.append(pd.DataFrame(-share[0], columns=names).assign(panel=series, t=t.astype(np.int32)))
        for c, panel in enumerate(panels):
            at = np.flatnonzero(seen[c])
            out.append(pd.DataFrame(total[c, at], columns=names).assign(panel=panel if less is None else None, t=at.astype(np.int32)))
        return pd.concat(out)[["panel", "t", *names]]

    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread_out = factors.select("panel", "f", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_b"))
    part = (rows.select("_b", "series", "t", "y").groupBy("_b").cogroup(spread_out.groupBy("_b"))
            .applyInPandas(add_up, "panel string, t int, " + ", ".join(f"{c} double" for c in names)))
    if less is not None:  # sums go to every candidate, a series' own share to its candidate only
        part = part.withColumn("panel", F.explode(F.when(F.col("panel").isNull(), F.array(*map(F.lit, sorted(less)))).otherwise(F.array("panel"))))
    cols = [F.sum(c) for c in names]
    return part.groupBy("panel", "t").agg(F.array(*cols[:len(iu[0])]).alias("j"), F.array(*cols[len(iu[0]):]).alias("h"))


def bucketed_rows(m: DataFrame, buckets: int | None = None) -> DataFrame:
    """Gathered series with a bucket for :func:`shared_information`, written once per selection."""
    buckets = buckets or int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(series_rows(m).withColumn("_b", F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int")))


def warm_fit(rows: DataFrame, parent: DataFrame, state: DataFrame, names: Sequence[str], k: int, n_iter: int, tol: float,
             buckets: int | None = None) -> tuple[DataFrame, int]:
    """Models without one of ``names`` each, by EM that goes on from the ``parent`` model's factors
    and ``state`` until no model's parameters move by ``tol`` (at most ``n_iter`` times).
    Returns the last scan, written, and the number of iterations. Where one bucket holds all series
    no sums cross tasks, so a candidate's iterations run in one task, candidates side by side."""
    state = state.drop("panel").withColumn("panel", F.explode(F.array(*map(F.lit, names)))).select("panel", "n_t", "a", "q", "x0", "p0")
    if buckets == 1 and n_iter > 0:
        return _warm_fit_in_tasks(rows, parent, state, names, k, n_iter, tol)
    scan, done = None, 0
    while done < n_iter:
        info = shared_information(rows, parent, k, names, buckets) if scan is None else shared_information(rows, _factor_rows(scan), k, buckets=buckets)
        moved = Observation()
        new = cut_lineage(_scan(info, state, k, len(names)).observe(moved, F.max("moved").alias("moved")))
        if scan is not None:
            discard(scan)
        scan, state, done = new, next_state(new), done + 1
        if (moved.get["moved"] or 0.0) < tol:
            break
    return scan, done


def _warm_fit_in_tasks(rows: DataFrame, parent: DataFrame, state: DataFrame, names: Sequence[str], k: int, n_iter: int, tol: float) -> tuple[DataFrame, int]:
    """:func:`warm_fit` of a panel of at most ``BUCKET_VALUES`` observations. A task writes its
    candidate's state after every iteration, as all candidates end with the same one."""
    smooth, iu = _scan_panel(k), np.triu_indices(k)

    def run(mine: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        f, now, n_t = start["f"].iloc[0], start, int(start["n_t"].iloc[0])
        own = [(np.asarray(t, dtype=int), np.asarray(y, dtype=float)) for t, y in zip(mine["t"], mine["y"])]
        out = []
        for i in range(1, n_iter + 1):
            total, seen = np.zeros((n_t, len(iu[0]) + k)), np.zeros(n_t, bool)
            for t, y in own:
                l, r = _loading_of(t, y, f, k)
                if l is not None:
                    w = r + INNOVATION_JITTER
                    total[t, :len(iu[0])] += np.outer(l, l)[iu] / w
                    total[t, len(iu[0]):] += y[:, None] * (l / w)
                    seen[t] = True
            at = np.flatnonzero(seen)
            scan = smooth(pd.DataFrame({"t": at, "j": list(total[at, :len(iu[0])]), "h": list(total[at, len(iu[0]):])}), now).iloc[:1]
            f = scan["f"].iloc[0]
            now = scan.rename(columns={"xs": "a", "xf": "q", "xm": "x0", "p": "p0"})
            out.append(scan.assign(i=i))
        return pd.concat(out)

    each = rows.select("series", "t", "y", F.explode(F.array(*map(F.lit, names))).alias("panel")).filter("panel <> series")
    start = state.join(parent.select("f"))  # one parent model, one row
    each, start = (spread(d, "panel", groups=len(names)).groupBy("panel") for d in (each, start))
    scans = cut_lineage(each.cogroup(start).applyInPandas(run, f"{_SCAN}, i int"))
    moved = {r["i"]: r["moved"] for r in scans.groupBy("i").agg(F.max("moved").alias("moved")).collect()}
    done = next((i for i in sorted(moved) if (moved[i] or 0.0) < tol), n_iter)
    last = scans.filter(F.col("i") == done).drop("i")
    last._scratch_path = scans._scratch_path
    return last, done


class Selection:
    """Greedy removal of predictors from one standardised panel, shared by all rounds and blocks.

    A parent model is fitted in full per factor count; a round continues all its candidates
    from the parent (:func:`warm_fit`), and the winner's models are the next parents. Dates are
    those of the full panel throughout. Names, scores and one number per iteration reach the driver."""

    def __init__(self, obs: DataFrame, target: str, predictors: Sequence[str], k: int | Sequence[int], train_end: str, oos_start: str,
                 oos_end: str, n_iter: int = DEFAULT_ITERATIONS, tol: float = SELECTION_TOLERANCE):
        self.target, self.keep, self.steps = target, sorted(predictors), []
        self.grid = [k] if isinstance(k, int) else sorted(k)
        self.days, self.n_iter, self.tol = (train_end, oos_start, oos_end), n_iter, tol
        obs = cut_lineage(obs.filter(F.col("series").isin([target, *self.keep])).select(F.lit("").alias("panel"), "series", "ts", "value"))
        z, scale = _standardised(obs, target, oos_end, oos_end)
        self.mean, self.std = scale.filter(F.col("series") == target).select("_m", "_s").first() or (0.0, 1.0)
        self.goal = obs.filter(F.col("series") == target).select("ts", "value")
        self.seen: dict[str, tuple] = {}  # scores of candidates of the present parent
        self.fits: dict[str, dict[int, DataFrame]] = {}
        fits = self._each([kk for kk in self.grid if kk < len(self.keep) + 1], lambda kk: fit_dfm(z, kk, n_iter))
        self.models = {kk: (fit["factors"], fit["state"]) for kk, fit in fits.items()}
        size = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(size, max(1, -(-z.count() // BUCKET_VALUES)))
        for fit in list(fits.values())[:1]:
            self.rows, self.stamps = bucketed_rows(fit["panel"], self.buckets), _stamps(fit["panel"], "W-FRI").drop("panel")
        self.best = max(((*s, -kk) for kk, (f, _) in self.models.items() for s in self._scores(f, kk).values()), default=None)

    @staticmethod
    def _each(counts: Sequence[int], fit: Callable) -> dict:
        """``fit`` of each factor count; their jobs are small and run side by side."""
        if len(counts) < 2:
            return {kk: fit(kk) for kk in counts}
        with ThreadPoolExecutor(len(counts)) as pool:
            return dict(zip(counts, pool.map(fit, counts)))

    def _scores(self, factors: DataFrame, k: int) -> dict[str, tuple[float, float]]:
        """(hit rate, -RMSE) per model from its factors and the target's loadings on them."""
        from tidepanel.operators.nowcast import nowcast_metrics

        own = self.rows.filter(F.col("series") == self.target).select("t", "y")
        dates = F.transform(F.sequence(F.lit(0), F.size("f") - 1, F.lit(k)), lambda i: F.slice("f", i + 1, k))
        factors = factors.select("panel", F.posexplode(dates).alias("t", "f"))
        prod = factors.join(own.select(F.explode(F.arrays_zip("t", "y")).alias("o")).select("o.t", "o.y"), "t")
        f = [F.get("f", F.lit(i)) for i in range(k)]
        prod = prod.groupBy("panel").agg(F.count("y").alias("n"), F.array(*[F.sum(f[a] * f[b]) for a in range(k) for b in range(a, k)]).alias("ff"),
                                         F.array(*[F.sum(x * F.col("y")) for x in f]).alias("fy"), F.array(*[F.sum(x) for x in f]).alias("f"),
                                         F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"))
        load = solve_loadings(prod, k).filter(F.col("l").isNotNull())
        now = (factors.join(load.select("panel", "l"), "panel").join(self.stamps, "t")
               .select("panel", "ts", (dot(F.col("f"), F.col("l")) * self.std + self.mean).alias("value")))
        return _scores(nowcast_metrics(now, self.goal, *self.days))

    def round(self, only: Sequence[str] | None = None, ahead: Sequence[str] = ()) -> bool:
        """Remove the predictor whose removal raises the score most; False if none does.
        Candidates ``ahead`` are fitted along and need no job of their own while the parent stays."""
        trials = [v for v in self.keep if only is None or v in only]
        if self.best is None or len(self.keep) < 2 or not trials:
            return False
        fresh = [v for v in self.keep if (v in trials or v in ahead) and v not in self.fits]
        if not self.fits.keys() >= set(trials):
            def fit(kk: int) -> tuple[DataFrame, dict]:
                scan, _ = warm_fit(self.rows, *self.models[kk], fresh, kk, self.n_iter, self.tol, self.buckets)
                return scan, self._scores(_factor_rows(scan), kk)
            got = self._each([kk for kk in self.models if kk < len(self.keep)], fit)
            for v in fresh:
                self.fits[v] = {kk: scan for kk, (scan, _) in got.items()}
                self.seen[v] = max(((*scores[v], -kk) for kk, (_, scores) in got.items() if v in scores), default=None)
        found = {v: self.seen[v] for v in trials if self.seen[v] is not None}
        gone = max(sorted(found), key=found.get, default=None)
        if gone is None or found[gone] <= self.best:
            return False
        self.keep.remove(gone)
        self.best = found[gone]
        self.steps.append((gone, self.best[0], -self.best[1], -self.best[2]))
        self.rows = cut_lineage(self.rows.filter(F.col("series") != gone))
        self.models = {}
        for kk, scan in self.fits[gone].items():
            mine = cut_lineage(scan.filter((F.col("panel") == gone) & (F.col("t") == -1)))
            self.models[kk] = _factor_rows(mine), next_state(mine)
        for scan in {id(d): d for f in self.fits.values() for d in f.values()}.values():
            discard(scan)
        self.fits, self.seen = {}, {}
        return True

    def run(self, only: Sequence[str] | None = None, max_rounds: int | None = None, ahead: Sequence[str] = ()) -> list[tuple]:
        """Rounds until nothing improves; the removals with score and factor count."""
        before = len(self.steps)
        while (max_rounds is None or len(self.steps) - before < max_rounds) and self.round(only, ahead):
            pass
        return self.steps[before:]


def backward_select(obs: DataFrame, target: str, predictors: Sequence[str], k: int | Sequence[int], train_end: str, oos_start: str,
                    oos_end: str, n_iter: int = DEFAULT_ITERATIONS, max_rounds: int | None = None, only: Sequence[str] | None = None,
                    tol: float = SELECTION_TOLERANCE) -> tuple[list[str], list[tuple]]:
    """Greedy removal of predictors of ``obs(series, ts, value)`` by (hit rate, -RMSE), with several
    factor counts ``k`` by (hit rate, -RMSE, -k). Returns the kept predictors and the removals with
    score and factor count; ``only`` limits what may go."""
    s = Selection(obs, target, predictors, k, train_end, oos_start, oos_end, n_iter, tol)
    s.run(only, max_rounds)
    return s.keep, s.steps


def backward_select_blocks(obs: DataFrame, target: str, blocks: dict[str, Sequence[str]], k: int | Sequence[int], train_end: str,
                           oos_start: str, oos_end: str, n_iter: int = DEFAULT_ITERATIONS, max_rounds: int | None = None,
                           tol: float = SELECTION_TOLERANCE) -> tuple[list[str], dict[str, list]]:
    """Backward selection block after block, each against all predictors still
    in; returns the kept predictors and the removals per block."""
    s = Selection(obs, target, sorted({v for members in blocks.values() for v in members}), k, train_end, oos_start, oos_end, n_iter, tol)
    log = {}
    for block in sorted(blocks):
        members = [v for v in blocks[block] if v in s.keep]
        if members:
            log[block] = s.run(members, max_rounds, [v for later in blocks if later > block for v in blocks[later]])
    return s.keep, log

"""Numeric helpers for unit-root tests, of one series and of many at once."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np

# MacKinnon's published response surface for the Dickey-Fuller
# tau statistic with one variable; c = constant, ct = constant and trend.
TAU_MAX = {"c": 2.74, "ct": 0.70}
TAU_MIN = {"c": -18.83, "ct": -16.18}
TAU_STAR = {"c": -1.61, "ct": -2.89}
TAU_SMALL_P = {"c": (2.1659, 1.4412, 0.038269), "ct": (3.2512, 1.6047, 0.049588)}
TAU_LARGE_P = {"c": (1.7339, 0.93202, -0.12745, -0.010368), "ct": (2.5261, 0.61654, -0.37956, -0.060285)}

# Published critical values of the trend KPSS statistic.
KPSS_TREND = ((0.119, 0.10), (0.146, 0.05), (0.176, 0.025), (0.216, 0.01))


def tau_pvalue(tau: float, trend: str) -> float:
    if tau > TAU_MAX[trend]:
        return 1.0
    if tau < TAU_MIN[trend]:
        return 0.0
    coef = TAU_SMALL_P[trend] if tau <= TAU_STAR[trend] else TAU_LARGE_P[trend]
    z = sum(c * tau ** i for i, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _design(y: np.ndarray, lags: int, rows: int, trend: str) -> tuple[np.ndarray, np.ndarray]:
    """Δy on y(-1), its own lags and the deterministic terms, last ``rows`` rows."""
    dy = np.diff(y)
    lo = len(dy) - rows
    cols = [y[lo:-1]] + [dy[lo - i:len(dy) - i] for i in range(1, lags + 1)]
    cols.append(np.ones(rows))
    if trend == "ct":
        cols.append(np.arange(1.0, rows + 1))
    return np.column_stack(cols), dy[lo:]


def adf(y: np.ndarray, trend: str = "c") -> tuple[float, int, float] | None:
    """(tau, lags, p) with the lag order of lowest AIC on a common sample; None
    when the series is too short."""
    n_det = len(trend)
    most = min(math.ceil(12.0 * (len(y) / 100.0) ** 0.25), len(y) // 2 - n_det - 1)
    if most < 0:
        return None
    rows = len(y) - 1 - most
    best, order = math.inf, 0
    for p in range(most + 1):
        x, d = _design(y, p, rows, trend)
        beta, *_ = np.linalg.lstsq(x, d, rcond=None)
        rss = float(np.sum((d - x @ beta) ** 2))
        aic = rows * (math.log(max(rss, 1e-300) / rows) + math.log(2 * math.pi) + 1) + 2 * x.shape[1]
        if aic < best:
            best, order = aic, p
    x, d = _design(y, order, len(y) - 1 - order, trend)
    beta, *_ = np.linalg.lstsq(x, d, rcond=None)
    free = x.shape[0] - x.shape[1]
    if free <= 0:
        return None
    s2 = float(np.sum((d - x @ beta) ** 2)) / free
    inv = np.linalg.pinv(x)[0]  # of x itself: the inverse of x'x loses series far from zero
    se = math.sqrt(s2 * float(inv @ inv))
    if se == 0.0:
        return None
    tau = float(beta[0] / se)
    return tau, order, tau_pvalue(tau, trend)


def _stack(y: np.ndarray, lags: int, rows: int, trend: str, level_last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Designs (series, rows, columns) and Δy of equally long series: deterministic terms,
    then the level before or after the lags."""
    dy = np.diff(y, axis=1)
    lo = dy.shape[1] - rows
    cols = [np.ones((len(y), rows))]
    if trend == "ct":
        cols.append(np.broadcast_to(np.arange(1.0, rows + 1), (len(y), rows)))
    level = [y[:, lo:-1]]
    past = [dy[:, lo - i:dy.shape[1] - i] for i in range(1, lags + 1)]
    cols += past + level if level_last else level + past
    return np.stack(cols, axis=2), dy[:, lo:]


def _sound(r: np.ndarray) -> np.ndarray:
    size = np.abs(np.diagonal(r, axis1=1, axis2=2))
    return size.min(axis=1) > 1e-9 * size.max(axis=1)


def adf_batch(series: Sequence[np.ndarray], trend: str = "c") -> list[tuple[float, int, float] | None]:
    """:func:`adf` of many series. Equally long ones share one stacked QR: the models of all
    lag orders are nested in its columns, so one factorisation gives all their residuals;
    the chosen orders are solved together again. Near-singular ones go one by one."""
    out: list[tuple[float, int, float] | None] = [None] * len(series)
    by_length = defaultdict(list)
    for i, y in enumerate(series):
        by_length[len(y)].append(i)
    n_det = len(trend)
    for n, members in by_length.items():
        most = min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - n_det - 1)
        if most < 0:
            continue
        at = np.array(members)
        y = np.stack([np.asarray(series[i], dtype=float) for i in members])
        rows = n - 1 - most
        x, d = _stack(y, most, rows, trend, level_last=False)
        q, r = np.linalg.qr(x)
        fit = np.cumsum(np.einsum("brc,br->bc", q, d) ** 2, axis=1)
        whole = (d * d).sum(axis=1)
        rss = whole[:, None] - fit[:, n_det:]
        width = np.arange(n_det + 1, n_det + most + 2)
        good = _sound(r) & (rss.min(axis=1) > 1e-8 * whole)
        aic = rows * (np.log(np.maximum(rss, 1e-300) / rows) + math.log(2 * math.pi) + 1) + 2 * width
        orders = aic.argmin(axis=1)
        for p in np.unique(orders[good]):
            pick = np.flatnonzero(good & (orders == p))
            x, d = _stack(y[pick], int(p), n - 1 - int(p), trend, level_last=True)
            free = x.shape[1] - x.shape[2]
            if free <= 0:
                continue
            q, r = np.linalg.qr(x)
            c = np.einsum("brc,br->bc", q, d)
            s2 = np.maximum((d * d).sum(axis=1) - (c * c).sum(axis=1), 0.0) / free
            ok = _sound(r) & (s2 > 0)
            good[pick[~ok]] = False
            for j, i in enumerate(pick):
                if ok[j]:
                    tau = float(c[j, -1] * np.sign(r[j, -1, -1]) / math.sqrt(s2[j]))
                    out[at[i]] = tau, int(p), tau_pvalue(tau, trend)
        for i in np.flatnonzero(~good):
            out[at[i]] = adf(y[i], trend)
    return out

"""Factor model, unit-root test, KPSS and DTW against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.unitroot import adf, adf_batch, tau_pvalue
from tidepanel.operators import factor as fa, nowcast as nc, properties as pr


@pytest.fixture(scope="module")
def toy(spark):
    """Twelve series on three factors, forty weeks, two fifths missing."""
    rng = np.random.default_rng(3)
    t, n, k = 40, 12, 2
    f = np.zeros((t, k))
    for i in range(1, t):
        f[i] = [[0.7, 0.1], [0.0, 0.5]] @ f[i - 1] + rng.normal(size=k)
    y = f @ rng.normal(size=(k, n)) + rng.normal(size=(t, n)) * 0.5
    y[rng.random((t, n)) < 0.4] = np.nan
    y[0, 0] = y[-1, 1] = 1.0
    day = [dt.date(2023, 1, 6) + dt.timedelta(days=7 * i) for i in range(t)]
    rows = [("m", f"s{j:02d}", day[i], float(y[i, j])) for i in range(t) for j in range(n) if not np.isnan(y[i, j])]
    return spark.createDataFrame(rows, "panel string, series string, ts date, value double"), y, day


def reference_em(y, k, n_iter):
    """EM in covariance form with a full gain, straight from the textbook."""
    t, n = y.shape
    yc = y - np.nanmean(y, axis=0)
    sd = np.nanstd(y, axis=0, ddof=1)
    z = np.nan_to_num(yc / sd)
    u, s, vh = np.linalg.svd(z, full_matrices=False)
    f = u[:, :k] * s[:k]
    sign = np.where(f[np.abs(f).argmax(0), range(k)] < 0, -1, 1)
    f = f * sign

    def loads(g):
        return np.array([np.linalg.lstsq(g[~np.isnan(yc[:, j])], yc[~np.isnan(yc[:, j]), j], rcond=None)[0] for j in range(n)])
    lam = loads(f)
    x = np.column_stack([np.ones(t - 1), f[:-1]])
    b = np.linalg.lstsq(x, f[1:], rcond=None)[0]
    a, q = b[1:].T, np.diag(np.maximum(np.var(f[1:] - x @ b, axis=0, ddof=1), 1e-6))
    r = np.maximum(np.var(z - f @ (sign[:, None] * vh[:k]), axis=0) * sd ** 2, 1e-6)
    x0, p0 = np.zeros(k), np.eye(k)

    def kalman():
        xf, xm, pf, pm = np.zeros((t, k)), np.zeros((t, k)), np.zeros((t, k, k)), np.zeros((t, k, k))
        xf[0] = xm[0] = x0
        pf[0] = pm[0] = p0
        gains = [np.zeros((k, n))] * t
        for i in range(1, t):
            xm[i], pm[i] = a @ xf[i - 1], a @ pf[i - 1] @ a.T + q + 1e-6 * np.eye(k)
            o = ~np.isnan(yc[i])
            h = lam[o]
            g = pm[i] @ h.T @ np.linalg.pinv(h @ pm[i] @ h.T + np.diag(r[o]) + 1e-4 * np.eye(o.sum()))
            xf[i] = xm[i] + g @ (yc[i, o] - h @ xm[i])
            p = (np.eye(k) - g @ h) @ pm[i]
            pf[i] = (p + p.T) / 2
            full = np.zeros((k, n))
            full[:, o] = g
            gains[i] = full
        return xf, xm, pf, pm, gains
    xs = None
    for _ in range(n_iter):
        xf, xm, pf, pm, _ = kalman()
        xs, ps = xf.copy(), pf.copy()
        for i in range(t - 2, -1, -1):
            j = pf[i] @ a.T @ np.linalg.pinv(pm[i + 1])
            xs[i] = xf[i] + j @ (xs[i + 1] - xm[i + 1])
            ps[i] = pf[i] + j @ (ps[i + 1] - pm[i + 1]) @ j.T
        lam = loads(xs)
        now, past = xs[1:], xs[:-1]
        a = now.T @ past @ np.linalg.pinv(past.T @ past + 1e-7 * np.eye(k))
        w, v = np.linalg.eigh(now.T @ now / (t - 1) - a @ (past.T @ past / (t - 1)) @ a.T)
        q = v @ np.diag(np.maximum(w, 1e-7)) @ v.T
        r = np.maximum(np.nanvar(yc - xs @ lam.T, axis=0), 1e-7)
        x0, p0 = xs[0], ps[0]
    return {"xs": xs, "lam": lam, "a": a, "q": q, "r": r, "final": kalman()}


@pytest.fixture(scope="module")
def fitted(toy):
    return fa.fit_dfm(toy[0], 2, 3), reference_em(toy[1], 2, 3)


def _vec(df, col, t):
    return np.array([r[col] for r in df.orderBy("t").collect()]).reshape(t, -1)


def test_em_matches_covariance_form(toy, fitted):
    m, want = fitted
    t = len(toy[2])
    assert np.allclose(_vec(m["smoothed"], "f", t), want["xs"], atol=1e-8)
    xf, xm, pf, _, _ = want["final"]
    assert np.allclose(_vec(m["filtered"], "x", t), xf, atol=1e-8)
    assert np.allclose(_vec(m["filtered"], "x_minus", t), xm, atol=1e-8)
    assert np.allclose(_vec(m["filtered"], "p", t), pf.reshape(t, -1), atol=1e-8)
    lam = {r.series: (r.l, r.r) for r in m["loadings"].collect()}
    for j in range(12):
        assert np.allclose(lam[f"s{j:02d}"][0], want["lam"][j], atol=1e-8)
        assert abs(lam[f"s{j:02d}"][1] - want["r"][j]) < 1e-8
    s = m["state"].first()
    assert np.allclose(s.a, want["a"].ravel(), atol=1e-8) and np.allclose(s.q, want["q"].ravel(), atol=1e-8)
    assert [r.ts for r in m["smoothed"].orderBy("t").collect()] == toy[2]


def test_panels_do_not_mix(toy):
    one = toy[0]
    two = one.unionByName(one.filter("series <> 's03'").withColumn("panel", F.lit("less")))
    a, b = fa.fit_dfm(two, 2, 1), fa.fit_dfm(one, 2, 1)
    x = {(r.t): r.f for r in a["smoothed"].filter("panel = 'm'").collect()}
    y = {(r.t): r.f for r in b["smoothed"].collect()}
    assert all(np.allclose(x[t], y[t], atol=1e-9) for t in y)


def test_pca_and_factor_count(toy):
    y = toy[1]
    z = np.nan_to_num((y - np.nanmean(y, axis=0)) / np.nanstd(y, axis=0, ddof=1))
    e = np.linalg.eigvalsh(np.cov(z, rowvar=False))[::-1]
    pca = fa.pca_variance(toy[0], 12)
    got = [r.eigenvalue for r in pca.orderBy("k").collect()]
    assert np.allclose(got, e, atol=1e-9)
    t, n = y.shape
    ic = [np.log(e[k:].sum() * t / (n * t)) + k * (n + t) / (n * t) * np.log(min(n, t)) for k in range(1, n)]
    best = int(np.argmin(ic)) + 1
    assert fa.select_k(pca, "bai_ng", cap=None).first().k == best
    assert fa.select_k(pca, "bai_ng").first().k == best  # no limit unless asked for
    first = fa.select_k(pca, "bai_ng", cap=fa.FIRST_STAGE_CAP).first()
    assert first.k == min(best, fa.FIRST_STAGE_CAP) and first.capped == (best > fa.FIRST_STAGE_CAP)
    assert fa.select_k(pca, "kaiser").first().k == max(1, int((e > 1).sum()))
    share = np.cumsum(e) / e.sum()
    assert fa.select_k(pca, "cumulative", cap=None).first().k == int(np.argmax(share >= 0.9)) + 1
    drop = np.abs(np.diff(e) / e[:-1])
    assert fa.select_k(pca, "elbow", cap=None).first().k == (int(np.argmax(drop < 0.1)) + 1 if (drop < 0.1).any() else 12)


def test_forecasts(toy, fitted):
    m, want = fitted
    xf = want["final"][0]
    got = {r.h: (r.x, r.ts) for r in nc.state_forecast(m, 2, 3).collect()}
    assert np.allclose(got[3][0], np.linalg.matrix_power(want["a"], 3) @ xf[-1], atol=1e-8)
    assert got[3][1] == toy[2][-1] + dt.timedelta(days=21)
    f = nc.forecast_to_month_end(m, "s00", 2).orderBy("ts").collect()
    for i, r in enumerate(f):
        assert abs(r.nowcast_std - want["lam"][0] @ np.linalg.matrix_power(want["a"], r.h) @ xf[i]) < 1e-8
        assert r.target_ts.month == r.ts.month and r.target_ts.weekday() == 4


def test_news_weights(toy, fitted):
    """Same vintage plus three new weeks and one revision."""
    m, want = fitted
    full = toy[0]
    old = full.filter(F.col("ts") <= F.lit(toy[2][-4]))
    old = old.withColumn("value", F.when((F.col("series") == "s05") & (F.col("ts") == F.lit(toy[2][-6])), F.col("value") + 1).otherwise(F.col("value")))
    now = nc.apply_vintage(m, full.withColumn("panel", F.lit("now")), 2, interpolate=False)
    before = nc.apply_vintage(m, old.withColumn("panel", F.lit("old")), 2, interpolate=False)
    items = nc.news(now, before, "s00", str(toy[2][-1]), 2).collect()
    y = toy[1]
    fresh = int((~np.isnan(y[-3:])).sum())
    revised = 0 if np.isnan(y[-6, 5]) else 1
    assert len(items) == fresh + revised
    gains = want["final"][4]
    mu = np.nanmean(y, axis=0)
    for r in items:
        i, j = toy[2].index(r.ts), int(r.series[1:])
        w = want["lam"][0] @ np.linalg.matrix_power(want["a"], len(y) - 1 - i) @ gains[i][:, j]
        assert abs(r.weight - w) < 1e-7
        assert abs(r.observed - y[i, j]) < 1e-9
        assert abs(r.news - (r.observed - r.forecast)) < 1e-9 and abs(r.impact - r.weight * r.news) < 1e-12
    last = [r for r in items if r.ts == toy[2][-3]]
    x = want["final"][1][-3]
    for r in last:
        j = int(r.series[1:])
        # first week past the old vintage: its smoothed end state moved one step
        end = _vec(before["smoothed"], "f", len(y) - 3)[-1]
        assert abs(r.forecast - mu[j] - want["lam"][j] @ want["a"] @ end) < 1e-7
    del x


def test_adf_is_ordinary_least_squares():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=120))
    tau, lags, p = adf(y, "c")
    dy = np.diff(y)
    n = len(dy) - lags
    x = np.column_stack([y[lags:-1], *[dy[lags - i:len(dy) - i] for i in range(1, lags + 1)], np.ones(n)])
    b = np.linalg.solve(x.T @ x, x.T @ dy[lags:])
    e = dy[lags:] - x @ b
    se = np.sqrt(e @ e / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    assert abs(tau - b[0] / se) < 1e-8 and 0.05 < p <= 1
    assert adf(rng.normal(size=200), "ct")[2] < 0.01
    assert adf(np.arange(3.0), "ct") is None


@pytest.mark.parametrize("trend", ["c", "ct"])
def test_adf_batch_is_adf_of_each(trend):
    rng = np.random.default_rng(1)
    made = [np.cumsum(rng.normal(size=n)) if k else rng.normal(size=n) * 1e4 + 1e6 for n in (5, 6, 9, 30, 119, 120, 358) for k in (0, 1) for _ in range(72)]
    made += [np.arange(40.0), np.full(40, 2.0) + np.eye(40)[3], np.tile([1.0, -1.0], 20), np.arange(3.0)]
    for got, y in zip(adf_batch(made, trend), made, strict=True):
        want = adf(y, trend)
        assert (got is None) == (want is None)
        if want is not None and np.isfinite(want[0]) and abs(want[0]) < 1e6:
            assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-6 * max(1, abs(want[0])) and abs(got[2] - want[2]) < 1e-6


@pytest.mark.parametrize("tau,trend,p", [(-2.86, "c", 0.05), (-3.43, "c", 0.01), (-3.41, "ct", 0.05), (-3.96, "ct", 0.01), (-2.57, "c", 0.10)])
def test_pvalues_at_published_critical_values(tau, trend, p):
    assert abs(tau_pvalue(tau, trend) - p) < 0.002


def brute_dtw(a, b, squared, radius=None):
    n, m = len(a), len(b)
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if radius is None or abs(i - j) <= max(radius, abs(n - m)):
                c = (a[i] - b[j]) ** 2 if squared else abs(a[i] - b[j])
                acc[i + 1, j + 1] = c + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    return acc[n, m]


@pytest.mark.parametrize("squared,radius", [(False, None), (True, None), (False, 3)])
def test_dtw_is_exact(spark, squared, radius):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=30), rng.normal(size=24)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    rows = [("a", day(i), float(v)) for i, v in enumerate(a)] + [("b", day(i), float(v)) for i, v in enumerate(b)] + [("e", day(0), None)]
    d = spark.createDataFrame(rows, "series string, ts date, value double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "e")], "target string, candidate string")
    got = {r.candidate: r for r in pr.dtw_batch(d, pairs, "squared" if squared else "abs", radius).collect()}
    assert abs(got["b"].distance - brute_dtw(a, b, squared, radius)) < 1e-9
    assert got["a"].distance == 0.0 and got["e"].distance is None and got["e"].note == "empty_series"
    path = list(zip(got["b"].path_i, got["b"].path_j))
    assert path[0] == (0, 0) and path[-1] == (29, 23)
    cost = sum((a[i] - b[j]) ** 2 if squared else abs(a[i] - b[j]) for i, j in path)
    assert abs(cost - got["b"].distance) < 1e-9


def test_adf_screen_adds_only_helpful_series(spark):
    rng = np.random.default_rng(5)
    walk, noise = np.cumsum(rng.normal(size=150)), rng.normal(size=150)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    d = spark.createDataFrame([(s, day(i), float(v)) for s, x in (("walk", walk), ("noise", noise)) for i, v in enumerate(x)], "series string, ts date, value double")
    summary, out = pr.adf_screen(d, method="diff")
    got = {r.series: r for r in summary.collect()}
    assert got["noise"].method == "original" and got["walk"].method == "diff1" and got["walk"].stationary
    assert {r.series for r in out.select("series").distinct().collect()} == {"walk", "noise", "walk_diff1"}


def test_backward_select_removes_noise(spark):
    rng = np.random.default_rng(11)
    t = 130
    f = np.cumsum(rng.normal(size=t)) * 0.3
    day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=7 * i)
    cols = {"target": f + rng.normal(size=t) * 0.1, "good": f + rng.normal(size=t) * 0.2, "fair": f + rng.normal(size=t) * 0.3, "junk": rng.normal(size=t) * 3}
    d = spark.createDataFrame([(s, day(i), float(v)) for s, x in cols.items() for i, v in enumerate(x)], "series string, ts date, value double")
    keep, steps = fa.backward_select(d, "target", ["good", "fair", "junk"], 1, "2022-06-24", "2022-07-01", "2023-06-30", n_iter=1, max_rounds=1)
    assert len(keep) in (2, 3) and len(steps) == 3 - len(keep)
    assert all(len(s) == 4 and s[3] == 1 for s in steps)


def selection_panel(spark):
    rng = np.random.default_rng(11)
    t = 130
    f = np.cumsum(rng.normal(size=t)) * 0.3
    day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=7 * i)
    cols = {"target": f + rng.normal(size=t) * 0.1, "good": f + rng.normal(size=t) * 0.2, "fair": f + rng.normal(size=t) * 0.3, "junk": rng.normal(size=t) * 3}
    return spark.createDataFrame([(s, day(i), float(v)) for s, x in cols.items() for i, v in enumerate(x)], "series string, ts date, value double")


DAYS = ("2022-06-24", "2022-07-01", "2023-06-30")


def test_downdated_sums_are_those_without_the_series(toy):
    obs, y, day = toy
    m = fa.model_panel(obs).withColumn("panel", F.lit(""))
    rows = fa.bucketed_rows(m)
    rng = np.random.default_rng(0)
    f = rng.normal(size=(len(day), 2))
    parent = obs.sparkSession.createDataFrame([("", f.ravel().tolist())], "panel string, f array<double>")
    names = ["s03", "s00", "s11"]
    got = {(r.panel, r.t): (r.j, r.h) for r in fa.shared_information(rows, parent, 2, names).collect()}
    load = {}
    for s in range(y.shape[1]):
        at = np.flatnonzero(~np.isnan(y[:, s]))
        v = y[at, s] - y[at, s].mean()
        load[s] = fa._loading_of(at, v, f, 2)
    for name in names:
        for t in range(len(day)):
            j, h = np.zeros((2, 2)), np.zeros(2)
            for s, (l, r) in load.items():
                if f"s{s:02d}" != name and not np.isnan(y[t, s]):
                    j += np.outer(l, l) / (r + fa.INNOVATION_JITTER)
                    h += l * (y[t, s] - np.nanmean(y[:, s])) / (r + fa.INNOVATION_JITTER)
            if (name, t) in got:
                assert np.allclose(got[name, t][0], j[np.triu_indices(2)]) and np.allclose(got[name, t][1], h)
            else:
                assert not j.any()


def test_shared_rows_give_each_model_its_own_sums(toy):
    """Several models at once against one at a time, by the path of :func:`fit_dfm`."""
    obs, y, day = toy
    spark = obs.sparkSession
    rows = fa.bucketed_rows(fa.model_panel(obs).withColumn("panel", F.lit("")))
    rng = np.random.default_rng(1)
    models = {n: rng.normal(size=(len(day), 2)) for n in ("s01", "s05", "other")}
    both = spark.createDataFrame([(n, f.ravel().tolist()) for n, f in models.items()], "panel string, f array<double>")
    got = {(r.panel, r.t): r.j + r.h for r in fa.shared_information(rows, both, 2).collect()}
    for n, f in models.items():
        scan = spark.createDataFrame([("", -1, f.ravel().tolist())], "panel string, t int, f array<double>")
        for r in fa.rows_information(rows.filter(F.col("series") != n), 2, scan=scan).collect():
            assert np.allclose(got.pop((n, r.t)), r.j + r.h)
    assert not got


def test_candidates_in_tasks_are_those_of_the_shuffled_sums(spark):
    d = selection_panel(spark)
    s = fa.Selection(d, "target", ["good", "fair", "junk"], 1, *DAYS, n_iter=8)
    assert s.buckets == 1
    (a, n), (b, m) = (fa.warm_fit(s.rows, *s.models[1], s.keep, 1, 25, 1e-3, x) for x in (1, None))
    assert n == m
    a, b = ({r["panel"]: r for r in x.filter("t = -1").collect()} for x in (a, b))
    assert a.keys() == b.keys() == set(s.keep)
    for v in a:
        for c in ("xs", "xf", "xm", "p", "f"):
            assert np.allclose(a[v][c], b[v][c], atol=1e-7)


def test_a_round_takes_few_jobs(spark):
    """Candidates of a small panel need no job per iteration."""
    s = fa.Selection(selection_panel(spark), "target", ["good", "fair", "junk"], 1, *DAYS, n_iter=12, tol=0.0)
    spark.sparkContext.setJobGroup("one round", "one round")
    try:
        s.round()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one round")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_warm_candidates_reach_the_cold_fit(spark):
    """Going on from the parent ends where a fit from scratch without the series ends."""
    d = selection_panel(spark)
    s = fa.Selection(d, "target", ["good", "fair", "junk"], 1, *DAYS, n_iter=15)
    scan, done = fa.warm_fit(s.rows, *s.models[1], s.keep, 1, 25, 1e-3)
    assert 1 < done <= 25
    warm = s._scores(fa._factor_rows(scan), 1)
    cold = d.select(F.explode(F.array(*map(F.lit, s.keep))).alias("panel"), "series", "ts", "value").filter("panel <> series")
    cold = fa._scores(fa.evaluate_models(cold, "target", 1, *DAYS, n_iter=40)[0])
    assert warm.keys() == cold.keys()
    for v in warm:
        assert abs(warm[v][0] - cold[v][0]) < 3 and abs(warm[v][1] - cold[v][1]) < 0.02 * abs(cold[v][1])


def test_selection_runs_to_its_end(spark):
    d, names = selection_panel(spark), ["good", "fair", "junk"]
    s = fa.Selection(d, "target", names, (1, 2), *DAYS, n_iter=8)
    first = s.best
    steps = s.run()
    scores = [first[:2], *((h, -r) for _, h, r, _ in steps)]
    assert all(a < b for a, b in zip(scores, scores[1:]) if a != b) and not s.round()
    assert sorted([*s.keep, *(x[0] for x in steps)]) == sorted(names)
    keep, log = fa.backward_select_blocks(d, "target", {"a": names}, (1, 2), *DAYS, n_iter=8)
    assert keep == s.keep and [x[0] for x in log["a"]] == [x[0] for x in steps]


def test_fit_end_keeps_later_data_out_of_the_fit(toy):
    """Parameters of an earlier fit window do not change with later values."""
    obs, y, day = toy
    cut, end = str(day[25]), str(day[-1])
    later = obs.withColumn("value", F.when(F.col("ts") > F.lit(cut).cast("date"), F.col("value") * 2).otherwise(F.col("value")))
    go = lambda d, **kw: fa.evaluate_models(d, "s00", 2, cut, str(day[26]), end, n_iter=1, **kw)
    loads = lambda m: {r.series: r.l for r in m["loadings"].collect()}
    a, b = loads(go(obs, fit_end=cut)[1]), loads(go(later, fit_end=cut)[1])
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    c = loads(go(later)[1])
    assert not all(np.allclose(a[k], c[k]) for k in a)
    assert go(obs, fit_end=cut)[0].first().oos_rmse is not None


def test_vintage_queries_join_the_tables_once(spark, monkeypatch):
    from tidepanel.catalog import base, factors

    calls, made = [], base.nation_week
    monkeypatch.setattr(base, "nation_week", lambda *a: calls.append(a) or made(*a))
    assert factors.n14_fixed(spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
    assert not any("lineitem" in f for f in factors._obs(spark, "/root/testdata/sf0.001").inputFiles())

"""Stationarity, lead-lag, DTW and win-rate queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import oracle, query, rnd
from tidepanel.operators import panel as p
from tidepanel.operators import properties as q

_T = "NATION_0"


def _dense(spark, sf):
    return p.densify(b.nation_week(spark, sf), "W-FRI")


@query("a1_adf_screen")
def a1(spark, sf):
    summary, _ = q.adf_screen(b.nation_week(spark, sf), method="diff")
    return rnd(summary)


@query("a1_adf_panel")
def a1p(spark, sf):
    _, panel = q.adf_screen(b.segment_month(spark, sf), method="log_diff")
    return rnd(panel)


@query("a2_ensure_stationary_log")
def a2(spark, sf):
    _, log = q.ensure_stationary(b.segment_month(spark, sf))
    return rnd(log)


@query("a2_ensure_stationary_panel")
def a2p(spark, sf):
    panel, _ = q.ensure_stationary(b.nation_week(spark, sf))
    return rnd(panel)


# Levels of 0 and above 1 fix every test's outcome, so the rest of the operators has SQL.

@query("a1_adf_nothing_rejected", oracle("SELECT DISTINCT series, false AS stationary_original, 'diff1' AS method, false AS stationary FROM nation_week", "nation_week"))
def a1n(spark, sf):
    return q.adf_screen(b.nation_week(spark, sf), alpha=0.0, method="diff")[0].select("series", "stationary_original", "method", "stationary")


def _signed(spark, sf):
    """Segments by month; every second one has values below zero."""
    return b.segment_month(spark, sf).withColumn("value", F.when(F.col("series") > "C", F.col("value") - 1000000).otherwise(F.col("value")))


_SIGNED = {"signed": "SELECT series, ts, CASE WHEN series > 'C' THEN value - 1000000 ELSE value END AS value FROM segment_month",
           "low": "SELECT series, min(value) > 0 AS pos FROM signed GROUP BY 1"}


@query("a2_all_transformed", oracle("""SELECT series, ts, round(CASE WHEN pos THEN lv - lag(lv) OVER w ELSE value - lag(value) OVER w END, 6) AS value
  FROM (SELECT *, ln(CASE WHEN pos THEN value END) AS lv FROM signed JOIN low USING (series)) WINDOW w AS (PARTITION BY series ORDER BY ts)""", "segment_month", ctes=_SIGNED))
def a2t(spark, sf):
    return rnd(q.ensure_stationary(_signed(spark, sf), 0.0)[0])


@query("a2_all_transformed_log", oracle("""SELECT series, CASE WHEN pos THEN 'log_diff' ELSE 'diff' END || '_still_nonstat' AS status FROM low""", "segment_month", ctes=_SIGNED))
def a2u(spark, sf):
    return q.ensure_stationary(_signed(spark, sf), 0.0)[1].select("series", "status")


_E = {"pos": "SELECT series, value, CAST(row_number() OVER (PARTITION BY series ORDER BY ts) AS DOUBLE) AS t FROM nation_week",
      "fit": "SELECT series, regr_slope(value, t) AS sl, regr_intercept(value, t) AS ic, count(*) AS n FROM pos GROUP BY 1",
      "e": "SELECT series, t, n, value - ic - sl * t AS e FROM pos JOIN fit USING (series)",
      "lg": "SELECT series, unnest(generate_series(0, 60)) AS k, n FROM fit",
      "ac": "SELECT a.series, k, a.n, sum(a.e * z.e) AS v FROM e a JOIN lg ON a.series = lg.series JOIN e z ON a.series = z.series AND z.t = a.t - k GROUP BY 1, 2, 3",
      "s01": "SELECT series, n, sum(CASE WHEN k = 0 THEN v / n ELSE v / (n / 2.0) END) AS s0, sum(k * v / (n / 2.0)) AS s1 FROM ac WHERE k <= floor(pow(n, 2.0 / 9.0)) GROUP BY 1, 2",
      "lag": "SELECT series, n, CAST(least(floor(1.1447 * pow((s1 / s0) * (s1 / s0), 1.0 / 3.0) * pow(n, 1.0 / 3.0)), n - 1) AS INTEGER) AS lags FROM s01",
      "lr": "SELECT series, lags, sum(CASE WHEN k = 0 THEN v ELSE 2 * (1 - k / (lags + 1.0)) * v END) / lag.n AS lv FROM ac JOIN lag USING (series) WHERE k <= lags GROUP BY 1, 2, lag.n",
      "cs": "SELECT series, n, sum(s * s) AS s2 FROM (SELECT series, n, sum(e) OVER (PARTITION BY series ORDER BY t) AS s FROM e) GROUP BY 1, 2",
      "st": "SELECT series, n, lags, s2 / (CAST(n AS DOUBLE) * n) / lv AS stat FROM cs JOIN lr USING (series)"}


@query("a3_kpss", oracle("""SELECT series, n, lags, round(stat, 6) AS stat, round(p, 6) AS p_value, p > 0.05 AS stationary FROM (SELECT *, CASE WHEN stat <= 0.119 THEN 0.10
  WHEN stat <= 0.146 THEN 0.10 + (stat - 0.119) * (0.05 - 0.10) / (0.146 - 0.119) WHEN stat <= 0.176 THEN 0.05 + (stat - 0.146) * (0.025 - 0.05) / (0.176 - 0.146)
  WHEN stat <= 0.216 THEN 0.025 + (stat - 0.176) * (0.01 - 0.025) / (0.216 - 0.176) ELSE 0.01 END::DOUBLE AS p FROM st)""", "nation_week", ctes=_E))
def a3(spark, sf):
    return rnd(q.kpss(b.nation_week(spark, sf)))


_LAG = {"i": f"SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) AS ps FROM dense",
        "pr": f"""SELECT x.series, CAST(o AS INTEGER) AS "offset", a.value AS a, x.value AS x FROM i x CROSS JOIN generate_series(-12, 12) t(o)
          JOIN i a ON a.series = '{_T}' AND a.ps = x.ps - o WHERE x.series <> '{_T}' AND a.value IS NOT NULL AND x.value IS NOT NULL""",
        "co": """SELECT series, "offset", corr(a, x) AS corr FROM pr GROUP BY 1, 2"""}


@query("l1_lag_correlation", oracle("""SELECT series, "offset", round(corr, 6) AS corr FROM co""", "nation_week", dense=("nation_week", "W"), ctes=_LAG))
def l1(spark, sf):
    return rnd(q.lag_correlation(_dense(spark, sf), _T, 12))


_BATCH = {"j": f"SELECT x.series, x.ts, a.value AS a, x.value AS x, row_number() OVER (PARTITION BY x.series ORDER BY x.ts) AS ps FROM nation_week x JOIN nation_week a ON a.ts = x.ts AND a.series = '{_T}' WHERE x.series <> '{_T}'",
          "c": "SELECT z.series, o, corr(y.a, z.x) AS r FROM j z CROSS JOIN generate_series(-12, 12) t(o) JOIN j y ON y.series = z.series AND y.ps = z.ps - o GROUP BY 1, 2"}


def _batch_sql(side):
    return oracle(f"""SELECT '{_T}' AS target, series, n_points, k AS lead, round(r, 6) AS corr, 'ok' AS note FROM (SELECT series, CAST(abs(o) AS INTEGER) AS k, r,
      row_number() OVER (PARTITION BY series ORDER BY abs(r) DESC, abs(o)) AS rn FROM c WHERE {side}) JOIN (SELECT series, count(*) AS n_points FROM j GROUP BY 1) USING (series) WHERE rn = 1""",
      "nation_week", ctes=_BATCH)


@query("l2_batch_lag_correlation", _batch_sql("o < 0"))
def l2(spark, sf):
    return rnd(q.batch_lag_correlation(b.nation_week(spark, sf), _T, 12))


@query("l2_batch_lag_correlation_raw", _batch_sql("o > 0"))
def l2r(spark, sf):
    return rnd(q.batch_lag_correlation(b.nation_week(spark, sf), _T, 12, "raw"))


_HIST = {"v": """SELECT c.series AS candidate, n.series, n.value FROM (SELECT DISTINCT series FROM nation_week WHERE series <> 'NATION_0') c
           JOIN nation_week n ON n.series IN (c.series, 'NATION_0')""",
         "sp": "SELECT candidate, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1",
         "h": "SELECT candidate, series, CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS c FROM v JOIN sp USING (candidate) GROUP BY 1, 2, 3",
         "g": """SELECT s.candidate, s.series, CAST(k AS INTEGER) AS bin, lo + k * ((hi - lo) / 10) AS left_edge, coalesce(c, 0) AS count, coalesce(c, 0) / CAST(n AS DOUBLE) AS probability
           FROM (SELECT candidate, series, count(*) AS n FROM v GROUP BY 1, 2) s CROSS JOIN generate_series(0, 9) t(k) JOIN sp USING (candidate)
           LEFT JOIN h ON h.candidate = s.candidate AND h.series = s.series AND h.bin = k"""}


@query("l3_histogram", oracle("SELECT candidate, series, bin, round(left_edge, 4) AS left_edge, count, round(probability, 6) AS probability FROM g", "nation_week", ctes=_HIST))
def l3(spark, sf):
    return rnd(q.histogram_pairs(b.nation_week(spark, sf), "NATION_0", 10), left_edge=4)


@query("l4_kl_divergence", oracle("""SELECT candidate, round(greatest(0.0, sum(CASE WHEN p > 0 THEN p * (ln(p) - ln(q / z)) ELSE 0 END)), 6) AS kl FROM (
  SELECT candidate, p, q, sum(q) OVER (PARTITION BY candidate) AS z FROM (SELECT candidate, bin, max(probability) FILTER (series = 'NATION_0') AS p,
    max(probability) FILTER (series = candidate) + 1e-9 AS q FROM g GROUP BY 1, 2)) GROUP BY 1""", "nation_week", ctes=_HIST))
def l4(spark, sf):
    return rnd(q.kl_pairs(q.histogram_pairs(b.nation_week(spark, sf), "NATION_0", 10), "NATION_0"))


@query("l5_overlap", oracle("""SELECT series, a AS target_value, x AS candidate_value FROM pr WHERE "offset" = -4""", "nation_week", dense=("nation_week", "W"), ctes=_LAG))
def l5(spark, sf):
    return q.overlap(_dense(spark, sf), _T, 4)


_KL = {**_LAG, "sp": """SELECT series, "offset", least(min(a), min(x)) AS lo, greatest(max(a), max(x)) AS hi, count(*) AS n FROM pr GROUP BY 1, 2""",
       "bk": """SELECT series, "offset", n, least(floor((a - lo) * 10 / (hi - lo)), 9) AS ba, least(floor((x - lo) * 10 / (hi - lo)), 9) AS bx FROM pr JOIN sp USING (series, "offset")""",
       "pa": """SELECT series, "offset", ba AS bin, count(*) / CAST(max(n) AS DOUBLE) AS p FROM bk GROUP BY 1, 2, 3""",
       "qx": """SELECT series, "offset", bx AS bin, count(*) / CAST(max(n) AS DOUBLE) AS q FROM bk GROUP BY 1, 2, 3""",
       "kl": """SELECT series, "offset", greatest(0.0, sum(p * (ln(p) - ln((coalesce(q, 0) + 1e-9) / (1 + 10e-9))))) AS kl FROM pa LEFT JOIN qx USING (series, "offset", bin) GROUP BY 1, 2""",
       "best": f"""SELECT '{_T}' AS target, c.series, c."offset" AS corr_offset, c.corr, k."offset" AS kl_offset, k.kl FROM
         (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(corr) DESC, "offset") AS rn FROM co) c JOIN
         (SELECT *, row_number() OVER (PARTITION BY series ORDER BY kl, "offset" DESC) AS rn FROM kl) k ON c.series = k.series AND c.rn = 1 AND k.rn = 1"""}


@query("l6_lead_lag", oracle("SELECT target, series, corr_offset, round(corr, 6) AS corr, kl_offset, round(kl, 6) AS kl, 'ok' AS note FROM best",
                             "nation_week", dense=("nation_week", "W"), ctes=_KL))
def l6(spark, sf):
    return rnd(q.lead_lag(_dense(spark, sf), _T, 12, 10))


@query("l7_interpret_lead_lag", oracle("""SELECT series, CASE WHEN abs(corr) >= 0.1 AND abs(corr_offset - kl_offset) <= 1 THEN 'strong' WHEN abs(corr) >= 0.1 THEN 'mixed' ELSE 'potential' END AS verdict,
  CASE sign(CASE WHEN abs(corr) >= 0.1 THEN corr_offset ELSE kl_offset END) WHEN 1 THEN 'candidate_lags' WHEN -1 THEN 'candidate_leads' ELSE 'synchronous' END AS direction FROM best""",
  "nation_week", dense=("nation_week", "W"), ctes=_KL))
def l7(spark, sf):
    return q.interpret_lead_lag(q.lead_lag(_dense(spark, sf), _T, 12, 10), 0.1).select("series", "verdict", "direction")


def _nation_pairs(spark, sf):
    n = b.nation_industry(spark, sf).select("series").filter(F.col("series") != _T)
    return n.select(F.lit(_T).alias("target"), F.col("series").alias("candidate"))


@query("l8_dtw")
def l8(spark, sf):
    out = q.dtw_batch(b.nation_week(spark, sf), _nation_pairs(spark, sf))
    return rnd(out.select("target", "candidate", "distance", F.size("path_i").alias("path_length"), "note"), 2)


@query("l8_dtw_band")
def l8b(spark, sf):
    out = q.dtw_batch(b.nation_week(spark, sf), _nation_pairs(spark, sf), "squared", 10)
    return rnd(out.select("target", "candidate", F.sqrt("distance").alias("root_distance"), "note"), 2)


def _dtw_sql(cost, radius=None):
    """All pairs of the monthly brand panel; the recursion goes row by row of the cost table."""
    gap = cost if radius is None else f"CASE WHEN abs(i + 1 - j) > greatest({radius}, abs(len(x) - len(y))) THEN 'inf'::DOUBLE ELSE {cost} END"
    return oracle("SELECT target, candidate, round(acc[len(acc)], 2) AS distance, 'ok' AS note FROM f WHERE i = len(x)", "brand_month", ctes={
        "v": "SELECT series, list(value ORDER BY ts) AS v FROM brand_month WHERE value IS NOT NULL GROUP BY 1",
        "pr": "SELECT a.series AS target, b.series AS candidate, a.v AS x, b.v AS y FROM v a JOIN v b ON a.series < b.series",
        "f": f"""SELECT target, candidate, x, y, 0 AS i, list_transform(y, lambda q: 'inf'::DOUBLE) AS acc FROM pr
          UNION ALL SELECT target, candidate, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [{gap}, acc[j],
            CASE WHEN j > 1 THEN acc[j - 1] WHEN i = 0 THEN 0.0 ELSE 'inf'::DOUBLE END]),
            lambda a, e: list_append(a, e[1] + least(e[2], e[3], coalesce(a[len(a)], 'inf'::DOUBLE))), []::DOUBLE[]) FROM f WHERE i < len(x)"""}).replace("WITH ", "WITH RECURSIVE ", 1)


def _brand_pairs(spark, sf):
    s = b.brand_month(spark, sf).select("series").distinct()
    return s.withColumnRenamed("series", "target").join(s.withColumnRenamed("series", "candidate"), F.col("target") < F.col("candidate"))


@query("l8_dtw_all_pairs", _dtw_sql("abs(x[i + 1] - y[j])"))
def l8all(spark, sf):
    return rnd(q.dtw_batch(b.brand_month(spark, sf), _brand_pairs(spark, sf)).select("target", "candidate", "distance", "note"), 2)


@query("l8_dtw_all_pairs_band", _dtw_sql("(x[i + 1] - y[j]) * (x[i + 1] - y[j])", 5))
def l8allb(spark, sf):
    return rnd(q.dtw_batch(b.brand_month(spark, sf), _brand_pairs(spark, sf), "squared", 5).select("target", "candidate", "distance", "note"), 2)


def _win_sql(r, start):
    return f"""SELECT '{r}' AS range, t.ts, s.series, s.d, t.d AS t FROM (SELECT series, ts, value - lag(value) OVER (PARTITION BY series ORDER BY ts) AS d FROM nation_week WHERE ts >= {start}) s
      JOIN (SELECT ts, value - lag(value) OVER (ORDER BY ts) AS d FROM nation_week WHERE series = '{_T}' AND ts >= {start}) t ON t.ts = s.ts
      WHERE s.series <> '{_T}' AND s.d IS NOT NULL AND t.d IS NOT NULL"""


@query("l9_win_rate", oracle(f"""SELECT '{_T}' AS target, series, range, count(*) AS n_common, count(*) FILTER (t <> 0) AS n_changes,
  round(100.0 * count(*) FILTER (t <> 0 AND sign(t) = sign(d)) / nullif(count(*) FILTER (t <> 0), 0), 6) AS win_rate FROM w GROUP BY 2, 3""", "nation_week",
  ctes={"w": " UNION ALL ".join([_win_sql("all", "DATE '0001-01-01'"), _win_sql("6m", "DATE '2001-05-09'"), _win_sql("1y", "DATE '2000-11-09'"), _win_sql("3y", "DATE '1998-11-09'")])}))
def l9(spark, sf):
    return rnd(q.win_rate(b.nation_week(spark, sf), _T, "2001-11-09"))

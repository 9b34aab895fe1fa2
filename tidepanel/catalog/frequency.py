"""Frequency inference, resampling and calendar queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import W_FRI, oracle, query, rnd, table
from tidepanel.functions import calendar as cal
from tidepanel.operators import frequency as f

_ALL = ("nation_week", "brand_day", "segment_month", "event_day")
_MANY = {"many": " UNION ALL ".join(f"SELECT '{p}:' || series AS series, ts, value FROM {p}" for p in _ALL),
         "g": "SELECT series, ts, ts - lag(ts) OVER (PARTITION BY series ORDER BY ts) AS gap FROM many"}


def _many(spark, sf):
    """Panels of four frequencies under one roof."""
    out = None
    for name in _ALL:
        d = getattr(b, name)(spark, sf)
        d = d.withColumn("series", F.concat(F.lit(f"{name}:"), "series"))
        out = d if out is None else out.unionByName(d)
    return out


_DAYS = "['W-MON','W-TUE','W-WED','W-THU','W-FRI','W-SAT','W-SUN']"
_CODES = {**_MANY, "st": f"""SELECT series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(gap) AS lo, max(gap) AS hi, median(gap) AS med,
  bool_and(ts = last_day(ts)) AS me, avg(CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END) AS ms_share, avg(CASE WHEN ts = last_day(ts) THEN 1 ELSE 0 END) AS me_share,
  avg(CASE WHEN gap = 1 THEN 1.0 WHEN gap IS NOT NULL THEN 0 END) AS d_share, avg(CASE WHEN gap BETWEEN 6 AND 8 THEN 1.0 WHEN gap IS NOT NULL THEN 0 END) AS w_share,
  avg(CASE WHEN gap BETWEEN 27 AND 32 THEN 1.0 WHEN gap IS NOT NULL THEN 0 END) AS m_share, mode(isodow(ts)) AS wd FROM g GROUP BY 1""",
  "cd": f"""SELECT *, CASE WHEN n < 3 THEN NULL WHEN me AND n = (year(last_ts)*12+month(last_ts)) - (year(first_ts)*12+month(first_ts)) + 1 THEN 'M'
  WHEN lo = hi AND lo = 7 THEN {_DAYS}[wd] WHEN lo = hi AND lo = 1 THEN 'D' WHEN lo = hi AND lo % 7 = 0 THEN (lo // 7) || {_DAYS}[wd] WHEN lo = hi THEN lo || 'D' END AS code FROM st""",
  "inf": f"""SELECT series, n, first_ts, last_ts, CASE WHEN n < 2 THEN 'Undetermined' WHEN code = 'M' THEN 'Monthly' WHEN code LIKE 'W%' OR w_share > 0.8 THEN 'Weekly'
  WHEN m_share > 0.8 THEN 'Monthly' WHEN code = 'D' OR (d_share > 0.6 AND hi < 6 AND w_share < 0.6) THEN 'Daily' WHEN code IS NOT NULL THEN 'Specific' ELSE 'Irregular' END AS freq_group,
  CASE WHEN n < 2 THEN NULL WHEN code IS NOT NULL THEN code WHEN w_share > 0.8 THEN {_DAYS}[wd] WHEN m_share > 0.8 THEN CASE WHEN ms_share > 0.6 THEN 'MS' WHEN me_share > 0.6 THEN 'ME' ELSE 'M' END
  WHEN d_share > 0.6 AND hi < 6 AND w_share < 0.6 THEN 'D' END AS freq_code FROM cd"""}


@query("f1_series_time_info", oracle("""SELECT series, first_ts AS start, last_ts AS "end", coalesce(code, CASE WHEN n < 2 THEN NULL WHEN me THEN 'ME' WHEN med BETWEEN 6 AND 8 THEN 'W-MON'
  WHEN med BETWEEN 28 AND 32 THEN CASE WHEN ms_share > 0.7 THEN 'MS' ELSE 'ME' END END) AS freq_code FROM cd""", *_ALL, ctes=_CODES))
def f1(spark, sf):
    return f.series_time_info(_many(spark, sf))


@query("f2_infer_frequency", oracle("SELECT * FROM inf", *_ALL, ctes=_CODES))
def f2(spark, sf):
    return f.infer_frequency(_many(spark, sf))


@query("f3_panel_frequency", oracle("""SELECT CASE WHEN 2 * n > tot THEN freq_group ELSE 'Mixed/Irregular' END AS freq_group,
  CASE WHEN 2 * n > tot THEN freq_code END AS freq_code, CAST(tot AS BIGINT) AS n_series FROM (SELECT freq_group, count(*) AS n, mode(freq_code) AS freq_code,
  sum(count(*)) OVER () AS tot FROM inf WHERE freq_group NOT IN ('Undetermined', 'Irregular') GROUP BY 1 ORDER BY n DESC LIMIT 1)""", *_ALL, ctes=_CODES))
def f3(spark, sf):
    return f.infer_panel_frequency(f.infer_frequency(_many(spark, sf)))


@query("f4_robust_infer", oracle("""SELECT series, coalesce(code, CASE WHEN lab IS NOT NULL AND sh > 0.5 THEN lab || ' (dominant)' WHEN lab IS NOT NULL THEN lab || ' (most common: ' || gap || ' days)'
  WHEN sh > 0.3 THEN 'main interval: ' || gap || ' days' ELSE 'irregular or mixed' END) AS frequency FROM cd JOIN (
  SELECT series, gap, c / t AS sh, CASE WHEN gap = 1 THEN 'daily' WHEN gap = 7 THEN 'weekly' WHEN gap BETWEEN 28 AND 31 THEN 'monthly' WHEN gap BETWEEN 89 AND 92 THEN 'quarterly'
   WHEN gap BETWEEN 360 AND 370 THEN 'annual' END AS lab FROM (SELECT series, gap, count(*) AS c, sum(count(*)) OVER (PARTITION BY series) AS t,
   row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, gap) AS rn FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE rn = 1) USING (series)""",
  *_ALL, ctes=_CODES))
def f4(spark, sf):
    return f.robust_infer(_many(spark, sf))


@query("f5_gap_profile", oracle("SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 3", *_ALL, ctes=_MANY))
def f5(spark, sf):
    return f.gap_profile(_many(spark, sf))


@query("f5_median_gap", oracle("SELECT CAST(median(gap) AS DOUBLE) AS median_gap FROM g WHERE gap IS NOT NULL", *_ALL, ctes=_MANY))
def f5m(spark, sf):
    return f.median_gap(_many(spark, sf))


# ---------------------------------------------------------------- resampling

_MEND = "last_day(ts)"
_QEND = "CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


def _bins_sql(label, agg, panel):
    return f"SELECT series, bin AS ts, {agg} AS value FROM (SELECT *, {label} AS bin FROM {panel}) GROUP BY 1, 2"


def _resample_sql(panel, label, agg, step, empty=None, places=6):
    ctes = {"binned": _bins_sql(label, agg, panel)}
    src = b.dense_sql("binned", step)
    val = f"coalesce(value, {empty})" if empty is not None else "value"
    return oracle(f"SELECT series, ts, round({val}, {places}) AS value FROM ({src})", panel, ctes=ctes)


@query("r1_resample_month_last", _resample_sql("brand_day", _MEND, "arg_max(value, ts)", "M"))
def r1_last(spark, sf):
    return rnd(f.resample(b.brand_day(spark, sf), "M", "last"))


@query("r1_resample_week_median", _resample_sql("brand_day", "CAST(ts + CAST((14 - isodow(ts)) % 7 AS INTEGER) AS DATE)", "median(value)", "W"))
def r1_median(spark, sf):
    return rnd(f.resample(b.brand_day(spark, sf), "W-SUN", "median"))


@query("r1_resample_day_sum", _resample_sql("event_day", "ts", "sum(value)", "D", 0, 2))
def r1_sum(spark, sf):
    return rnd(f.resample(b.event_day(spark, sf), "D", "sum"), 2)


_BDAY = "CAST({0} - CAST(CASE WHEN isodow({0}) > 5 THEN isodow({0}) - 5 ELSE 0 END AS INTEGER) AS DATE)"


@query("r1_resample_business_first", oracle("""SELECT s.series, c.ts, p.value FROM (SELECT DISTINCT series FROM brand_day) s
  CROSS JOIN (SELECT * FROM cal WHERE isodow(ts) <= 5) c LEFT JOIN binned p ON p.series = s.series AND p.ts = c.ts""", "brand_day", ctes={
    "binned": f"SELECT series, bin AS ts, arg_min(value, ts) AS value FROM (SELECT *, {_BDAY.format('ts')} AS bin FROM brand_day) GROUP BY 1, 2",
    "cal": f"""SELECT CAST(g AS DATE) AS ts FROM (SELECT {_BDAY.format('min(ts)')} AS lo, max(ts) AS hi FROM brand_day),
      generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) t(g)"""}))
def r1_business(spark, sf):
    return f.resample(b.brand_day(spark, sf), "B", "first")


@query("r1_resample_quarter_mean", oracle("""SELECT s.series, c.ts, round(p.value, 6) AS value FROM (SELECT DISTINCT series FROM brand_day) s CROSS JOIN cal c
  LEFT JOIN q p ON p.series = s.series AND p.ts = c.ts""", "brand_day", ctes={
    "q": f"SELECT series, qe AS ts, avg(value) AS value FROM (SELECT *, {_QEND} AS qe FROM brand_day) GROUP BY 1, 2",
    "cal": """SELECT CAST(g + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ts FROM (SELECT date_trunc('quarter', min(ts)) AS lo, date_trunc('quarter', max(ts)) AS hi FROM brand_day),
      generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 3 MONTH) t(g)"""}))
def r1_quarter(spark, sf):
    return rnd(f.resample(b.brand_day(spark, sf), "Q", "mean"))


@query("r1_resample_raw_events", oracle("""SELECT event_type AS series, CAST(ts AS DATE) AS ts, round(median(value), 6) AS med, max(value) AS hi FROM events GROUP BY 1, 2"""))
def r1_raw(spark, sf):
    e = b.event_raw(spark, sf).select("series", "ts", "value")
    med = f.resample(e, "D", "median", dense=False).withColumnRenamed("value", "med")
    return rnd(med.join(f.resample(e, "D", "max", dense=False).withColumnRenamed("value", "hi"), ["series", "ts"]))


_TS_FRI = W_FRI.replace("isodow(d)", "isodow(ts)").replace("d +", "ts +")


@query("r2_weekly_friday_last", _resample_sql("brand_day", _TS_FRI, "arg_max(value, ts)", "W"))
def r2(spark, sf):
    return rnd(f.to_weekly_friday(b.brand_day(spark, sf), "weekly"))


@query("r2_weekly_friday_mean", _resample_sql("flag_day", _TS_FRI, "avg(value)", "W"))
def r2d(spark, sf):
    return rnd(f.to_weekly_friday(b.flag_day(spark, sf), "daily"))


@query("r3_to_daily", oracle("SELECT series, ts, round(value, 6) AS value FROM (" + b.dense_sql("m", "D") + ")", "event_raw",
                             ctes={"m": "SELECT series, ts, avg(value) AS value FROM event_raw GROUP BY 1, 2"}))
def r3(spark, sf):
    return rnd(f.to_daily(b.event_raw(spark, sf).drop("seq")))


@query("r4_align_month_business", oracle("""SELECT series, CAST(m - CAST(CASE WHEN isodow(m) > 5 THEN isodow(m) - 5 ELSE 0 END AS INTEGER) AS DATE) AS ts, value
  FROM (SELECT series, last_day(ts) AS m, arg_max(value, ts) AS value FROM brand_day GROUP BY 1, 2)""", "brand_day"))
def r4(spark, sf):
    return f.align_to_period(b.brand_day(spark, sf), "month", "last", business=True)


@query("r4_align_week_first", oracle("""SELECT series, week AS ts, value FROM (
  SELECT series, CAST(ts + CAST((8 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS week, arg_min(value, ts) AS value
  FROM brand_day GROUP BY 1, 2)""", "brand_day"))
def r4w(spark, sf):
    return f.align_to_period(b.brand_day(spark, sf), "week", "first")


@query("r5_asfreq_month_end", oracle("""SELECT s.series, c.ts, p.value FROM (SELECT DISTINCT series FROM brand_day) s CROSS JOIN
  (SELECT last_day(CAST(g AS DATE)) AS ts FROM (SELECT date_trunc('month', min(ts)) lo, date_trunc('month', max(ts)) hi FROM brand_day), generate_series(lo, hi, INTERVAL 1 MONTH) t(g)) c
  LEFT JOIN brand_day p ON p.series = s.series AND p.ts = c.ts""", "brand_day"))
def r5(spark, sf):
    return f.asfreq(b.brand_day(spark, sf), "M")


_BORROW = {"v": "SELECT series, ts, value FROM brand_day WHERE value > 20",
           "bins": f"SELECT series, {_TS_FRI} AS bin, count(*) AS n, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM v GROUP BY 1, 2",
           "calw": f"SELECT CAST(g AS DATE) AS bin FROM (SELECT min({_TS_FRI}) lo, max({_TS_FRI}) hi FROM brand_day), generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY) t(g)",
           "d": """SELECT s.series, c.bin AS ts, coalesce(n, 0) AS n, f, l, row_number() OVER (PARTITION BY s.series ORDER BY c.bin) AS i FROM
             (SELECT DISTINCT series FROM v) s CROSS JOIN calw c LEFT JOIN bins b ON b.series = s.series AND b.bin = c.bin""",
           "p": "SELECT a.*, (a.n = 0 AND coalesce(z.n, 0) >= 2) AS lent, z.f AS zf FROM d a LEFT JOIN d z ON a.series = z.series AND z.i = a.i + 1",
           "q": "SELECT a.*, coalesce(y.n > 0 OR y.lent, false) AS after FROM p a LEFT JOIN p y ON a.series = y.series AND y.i = a.i - 1"}


@query("r6_value_align", oracle("""SELECT series, ts, n, CASE WHEN lent THEN zf WHEN n = 1 THEN f WHEN n >= 2 AND after THEN l WHEN n >= 2 THEN f END AS value,
  CASE WHEN lent THEN 'lent_by_next' WHEN n = 1 THEN 'single' WHEN n >= 2 AND after THEN 'last_of_several' WHEN n >= 2 THEN 'first_of_several' END AS event FROM q""",
  "brand_day", ctes=_BORROW))
def r6(spark, sf):
    d = b.brand_day(spark, sf)
    d = d.withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return f.value_align(d, "W-FRI")


@query("r7_align_frequency_report", oracle(f"""SELECT series, n_before, n_after FROM (SELECT series, count(*) AS n_before FROM brand_day GROUP BY 1) JOIN
  (SELECT series, count(DISTINCT last_day(ts)) AS n_after FROM brand_day GROUP BY 1) USING (series)""", "brand_day"))
def r7(spark, sf):
    _, report = f.align_frequency(b.brand_day(spark, sf), "D", "M", "value_align", "mean")
    return report


@query("r7_align_frequency_weekly", _resample_sql("brand_day", _TS_FRI, "avg(value)", "W"))
def r7w(spark, sf):
    out, _ = f.align_frequency(b.brand_day(spark, sf), "D", "W-FRI", "stat_align", "mean", complete=True)
    return rnd(out)


@query("r8_snap_week", oracle("""SELECT series, day AS ts, value FROM (
  SELECT series, CAST(ts + CAST(3 - isodow(ts) AS INTEGER) AS DATE) AS day, sum(value) AS value
  FROM brand_day GROUP BY 1, 2)""", "brand_day"))
def r8(spark, sf):
    return f.snap_dates(b.brand_day(spark, sf), "week", 2, "sum")


@query("r8_snap_month_day", oracle("""SELECT series, CAST(date_trunc('month', ts) AS DATE) + CAST(least(30, day(last_day(ts))) - 1 AS INTEGER) AS t, round(avg(value), 6) AS v FROM brand_day GROUP BY 1, 2""", "brand_day"))
def r8m(spark, sf):
    return rnd(f.snap_dates(b.brand_day(spark, sf), "month", 30, "mean").select("series", F.col("ts").alias("t"), F.col("value").alias("v")))


@query("r9_complete_index", oracle("SELECT series, ts, value FROM dense", "brand_day", dense=("brand_day", "D")))
def r9(spark, sf):
    return f.complete_index(b.brand_day(spark, sf), "D")


@query("r10_nearest_friday", oracle("""SELECT series, CAST(ts + CAST(5 - isodow(ts) AS INTEGER) AS DATE) AS friday, arg_max(value, ts) AS value FROM brand_day GROUP BY 1, 2""", "brand_day"))
def r10(spark, sf):
    return f.align_nearest_friday(b.brand_day(spark, sf)).withColumnRenamed("ts", "friday")


@query("r11_month_last_friday", oracle("""SELECT series, CAST(last_day(ts) - CAST((isodow(last_day(ts)) + 2) % 7 AS INTEGER) AS DATE) AS friday, arg_max(value, ts) AS value FROM brand_day GROUP BY 1, 2""", "brand_day"))
def r11(spark, sf):
    return f.align_month_last_friday(b.brand_day(spark, sf)).withColumnRenamed("ts", "friday")


@query("r12_target_calendar", oracle("""SELECT CAST(g AS DATE) AS ts FROM (SELECT greatest(lo - CAST((isodow(lo) + 2) % 7 AS INTEGER), DATE '1995-12-29') AS a,
  least(hi + CAST((12 - isodow(hi)) % 7 AS INTEGER), DATE '2003-01-03') AS z FROM (SELECT min(ts) lo, max(ts) hi FROM brand_day)), generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY) t(g)""", "brand_day"))
def r12(spark, sf):
    return f.target_calendar(b.brand_day(spark, sf), "1996-01-01", "2003-01-03")


@query("r15_friday_of_iso_week", """SELECT DISTINCT isoyear(o_orderdate) AS y, week(o_orderdate) AS w,
  CAST(CAST(o_orderdate AS DATE) + CAST(5 - isodow(o_orderdate) AS INTEGER) AS DATE) AS friday FROM orders""")
def r15(spark, sf):
    o = table(spark, sf, "orders").select(F.expr("extract(yearofweek from o_orderdate)").alias("y"), F.weekofyear("o_orderdate").alias("w")).distinct()
    return o.select("y", "w", cal.friday_of_iso_week(F.col("y"), F.col("w")).alias("friday"))

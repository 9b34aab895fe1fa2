"""Growth, diffusion, seasonal and pivot queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import oracle, query, r, rnd
from tidepanel.operators import growth as g


def _summary_sql(src, offsets):
    at = ",\n".join(f"max(CASE WHEN p.ts = l.lt - {d} THEN value END) AS value_{n}" for n, d in offsets.items())
    grow = ",\n".join(r(f"(last_value - value_{n}) / nullif(abs(value_{n}), 0)", f"growth_{n}") for n in offsets)
    vals = ", ".join(f"round(value_{n}, 2) AS value_{n}" for n in offsets)
    return {
        "l": f"SELECT series, max(ts) AS lt FROM {src} GROUP BY 1",
        "s0": f"""SELECT series, lt AS last_ts, max(CASE WHEN p.ts = l.lt THEN value END) AS last_value, {at},
          max(CASE WHEN year(ts) BETWEEN year(lt)-5 AND year(lt)-1 THEN value END) AS max_5y,
          min(CASE WHEN year(ts) BETWEEN year(lt)-5 AND year(lt)-1 THEN value END) AS min_5y,
          avg(CASE WHEN year(ts) BETWEEN year(lt)-5 AND year(lt)-1 THEN value END) AS mean_5y
          FROM {src} p JOIN l USING (series) GROUP BY series, lt""",
        "summary": f"""SELECT series, last_ts, round(last_value,2) AS last_value, {vals}, {grow},
          round(max_5y,2) AS max_5y, round(min_5y,2) AS min_5y, round(mean_5y,4) AS mean_5y FROM s0""",
    }


def _tidy(df):
    vals = {c: 2 for c in df.columns if c.startswith(("value_", "last_value", "max_5y", "min_5y"))}
    return rnd(df, mean_5y=4, **vals)


def _overview_sql(up):
    cnt = ",\n".join(f"count(*) FILTER (growth_{u} > 0) AS up_{u}" for u in up)
    names = [f"up_{u}" for u in up] + ["above_max", "below_min", "above_mean", "below_mean"]
    pct = ", ".join(r(f"100.0 * {n} / n_series", f"{n}_pct") for n in names)
    return f"""SELECT industry, n_series, {', '.join(names)}, {pct} FROM (
      SELECT CASE WHEN grouping(industry) = 1 THEN '合计' ELSE industry END AS industry, count(*) AS n_series,
        {cnt}, count(*) FILTER (last_value > max_5y) AS above_max, count(*) FILTER (last_value < min_5y) AS below_min,
        count(*) FILTER (last_value > mean_5y) AS above_mean, count(*) FILTER (last_value < mean_5y) AS below_mean
      FROM s1 GROUP BY ROLLUP (industry))"""


_grow_all = lambda offs: ", ".join(f"(last_value - value_{n}) / nullif(abs(value_{n}), 0) AS growth_{n}" for n in offs)


def _overview_ctes(src, offsets, dim):
    c = _summary_sql(src, offsets)
    del c["summary"]
    c["s1"] = f"SELECT s0.*, {_grow_all(offsets)}, coalesce(industry, '未分类') AS industry FROM s0 LEFT JOIN {dim} USING (series)"
    return c


@query("g1_weekly_growth", oracle("SELECT * FROM summary", "nation_week", ctes=_summary_sql("nation_week", g.WEEKLY_OFFSETS)))
def g1(spark, sf):
    return _tidy(g.weekly_growth_summary(b.nation_week(spark, sf)))


@query("g2_daily_growth", oracle("SELECT * FROM summary", "flag_day", ctes=_summary_sql("flag_day", g.DAILY_OFFSETS)))
def g2(spark, sf):
    return _tidy(g.daily_growth_summary(b.flag_day(spark, sf)))


@query("g3_monthly_growth", oracle("""
  SELECT series, strftime(lt, '%Y-%m') AS last_month, round(last_value,2) AS last_value, round(value_m1,2) AS value_m1,
    round(value_m12,2) AS value_m12, round(last_value - value_m1, 6) AS growth_m1, round(last_value - value_m12, 6) AS growth_m12,
    round(max_5y,2) AS max_5y, round(min_5y,2) AS min_5y, round(mean_5y,4) AS mean_5y FROM (
  SELECT series, lt, max(value) FILTER (ts = lt) AS last_value,
    arg_max(value, ts) FILTER (back = 1) AS value_m1, arg_max(value, ts) FILTER (back = 12) AS value_m12,
    max(value) FILTER (h) AS max_5y, min(value) FILTER (h) AS min_5y, avg(value) FILTER (h) AS mean_5y
  FROM (SELECT p.*, lt, (year(lt)*12+month(lt)) - (year(ts)*12+month(ts)) AS back,
        year(ts) BETWEEN year(lt)-5 AND year(lt)-1 AS h FROM segment_month p
        JOIN (SELECT series, max(ts) AS lt FROM segment_month GROUP BY 1) USING (series)) GROUP BY 1, 2)""",
  "segment_month"))
def g3(spark, sf):
    return _tidy(g.monthly_growth_summary(b.segment_month(spark, sf)))


@query("g4_weekly_report", oracle("""
  SELECT series, rd AS report_ts, round(last_value,2) AS last_value, round(value_w1,2) AS value_w1, round(value_w52,2) AS value_w52,
    round(last_value / nullif(value_w1,0) - 1, 6) AS growth_w1, round(last_value / nullif(value_w52,0) - 1, 6) AS growth_w52,
    round(max_5y,2) AS max_5y, round(min_5y,2) AS min_5y, round(mean_5y,4) AS mean_5y FROM (
  SELECT series, rd, max(value) FILTER (ts = rd) AS last_value, max(value) FILTER (ts = rd - 7) AS value_w1,
    arg_max(value, ts) FILTER (ts <= rd - 364) AS value_w52,
    max(value) FILTER (ts BETWEEN rd - 1825 AND rd) AS max_5y, min(value) FILTER (ts BETWEEN rd - 1825 AND rd) AS min_5y,
    avg(value) FILTER (ts BETWEEN rd - 1825 AND rd) AS mean_5y
  FROM nation_week, (SELECT max(ts) AS rd FROM nation_week) GROUP BY 1, 2)""", "nation_week"))
def g4(spark, sf):
    return _tidy(g.weekly_report(b.nation_week(spark, sf)))


@query("g4_weekly_report_fixed_date", oracle("""
  SELECT series, rd AS report_ts, round(last_value / nullif(value_w1,0) - 1, 6) AS growth_w1,
    round(last_value / nullif(value_w52,0) - 1, 6) AS growth_w52 FROM (
  SELECT series, rd, max(value) FILTER (ts = rd) AS last_value, max(value) FILTER (ts = rd - 7) AS value_w1,
    arg_max(value, ts) FILTER (ts <= rd - 364) AS value_w52 FROM nation_week, (SELECT DATE '1999-12-31' AS rd) GROUP BY 1, 2)""",
  "nation_week"))
def g4_fixed(spark, sf):
    out = g.weekly_report(b.nation_week(spark, sf), "1999-12-31")
    return rnd(out.select("series", "report_ts", "growth_w1", "growth_w52"))


@query("g5_industry_overview", oracle(_overview_sql(["w1", "w4", "w52"]), "nation_week", "nation_industry",
                                      ctes=_overview_ctes("nation_week", g.WEEKLY_OFFSETS, "nation_industry")))
def g5(spark, sf):
    s = g.weekly_growth_summary(b.nation_week(spark, sf))
    return rnd(g.industry_overview(s, b.nation_industry(spark, sf), ["growth_w1", "growth_w4", "growth_w52"]))


@query("g5_daily_overview", oracle(_overview_sql(list(g.DAILY_OFFSETS)), "flag_day", "flag_industry",
                                   ctes=_overview_ctes("flag_day", g.DAILY_OFFSETS, "flag_industry")))
def g5d(spark, sf):
    s = g.daily_growth_summary(b.flag_day(spark, sf))
    return rnd(g.industry_overview(s, b.flag_industry(spark, sf), [f"growth_{n}" for n in g.DAILY_OFFSETS]))


@query("g6_industry_table", oracle("""SELECT series, last_ts, last_value, growth_w1, growth_w4, growth_w52
  FROM summary JOIN nation_industry USING (series) WHERE industry = 'ASIA'""", "nation_week", "nation_industry",
  ctes=_summary_sql("nation_week", g.WEEKLY_OFFSETS)))
def g6(spark, sf):
    s = _tidy(g.weekly_growth_summary(b.nation_week(spark, sf)))
    t = g.industry_summary_table(s, b.nation_industry(spark, sf), "ASIA", "growth_w1")
    return t.select("series", "last_ts", "last_value", "growth_w1", "growth_w4", "growth_w52")


@query("g7_rank_latest_change", oracle("""SELECT series, latest, previous,
  round(CASE WHEN previous IS NULL THEN 0 WHEN previous = 0 THEN CAST('inf' AS DOUBLE) ELSE (latest - previous) / previous END, 6) AS change
  FROM (SELECT series, max(value) FILTER (rn = 1) AS latest, max(value) FILTER (rn = 2) AS previous FROM
   (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS rn FROM nation_week) GROUP BY 1)""", "nation_week"))
def g7(spark, sf):
    return rnd(g.rank_by_latest_change(b.nation_week(spark, sf)))


def _diff_sql(panel, n, thr, where="true"):
    return {
        "cal": f"SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM {panel} WHERE {where})",
        "pc": f"""SELECT a.ts, a.series, (a.value / nullif(p.value, 0) - 1) * 100 AS pct FROM
          (SELECT * FROM {panel} JOIN cal USING (ts)) a LEFT JOIN (SELECT * FROM {panel} JOIN cal USING (ts)) p
          ON a.series = p.series AND p.pos = a.pos - {n}""",
        "di": f"""SELECT ts, count(*) FILTER (pct > {thr}) AS n_above, count(pct) AS n_valid,
          coalesce(100.0 * count(*) FILTER (pct > {thr}) / nullif(count(pct), 0), 0.0) AS diffusion FROM pc GROUP BY 1""",
    }


@query("g8_diffusion_weekly_yoy", oracle("SELECT ts, n_above, n_valid, round(diffusion, 6) AS diffusion FROM di",
                                         "nation_week", ctes=_diff_sql("nation_week", 52, 0)))
def g8(spark, sf):
    return rnd(g.diffusion_index(b.nation_week(spark, sf), "weekly", "yoy"))


@query("g8_diffusion_daily_pop", oracle("SELECT ts, n_above, n_valid, round(diffusion, 6) AS diffusion FROM di",
                                        "brand_day", ctes=_diff_sql("brand_day", 1, 5)))
def g8d(spark, sf):
    return rnd(g.diffusion_index(b.brand_day(spark, sf), "daily", "pop", threshold=5.0))


@query("g8_diffusion_monthly_yoy", oracle("SELECT ts, n_above, n_valid, round(diffusion, 6) AS diffusion FROM di",
                                          "segment_month", ctes=_diff_sql("segment_month", 12, 0)))
def g8m(spark, sf):
    return rnd(g.diffusion_index(b.segment_month(spark, sf), "monthly", "yoy", rule="M"))


@query("g9_diffusion_stats", oracle("""SELECT round(arg_max(diffusion, ts), 6) AS "last", round(max(diffusion), 6) AS max,
  round(min(diffusion), 6) AS min, round(avg(diffusion), 6) AS mean,
  round(arg_max(d, ts), 6) AS change, CASE WHEN arg_max(d, ts) > 0 THEN 'up' WHEN arg_max(d, ts) < 0 THEN 'down' ELSE 'flat' END AS direction
  FROM (SELECT *, diffusion - lag(diffusion) OVER (ORDER BY ts) AS d FROM di)""", "nation_week",
  ctes=_diff_sql("nation_week", 52, 0)))
def g9(spark, sf):
    return rnd(g.diffusion_stats(g.diffusion_index(b.nation_week(spark, sf), "weekly", "yoy")))


@query("g10_base_period", oracle("""SELECT ts, n_above, n_valid, round(diffusion, 6) AS diffusion FROM di
  WHERE ts BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""", "nation_week", ctes=_diff_sql("nation_week", 52, 0)))
def g10(spark, sf):
    return rnd(g.diffusion_index(b.nation_week(spark, sf), "weekly", "yoy", start="1999-01-01",
                                 end="1999-12-31", rule="W-FRI"))


@query("g11_growth_heatmap", oracle("""SELECT industry, series, pc.ts, CAST(1 + (SELECT max(pos) FROM cal) - pos AS BIGINT) AS period,
  round(pct, 6) AS pct, round(max(CASE WHEN pos = (SELECT max(pos) FROM cal) THEN pct END) OVER (PARTITION BY series), 6) AS newest_pct
  FROM pc JOIN cal USING (ts) JOIN nation_industry USING (series) WHERE pos > (SELECT max(pos) FROM cal) - 15""",
  "nation_week", "nation_industry", ctes=_diff_sql("nation_week", 52, 0)))
def g11(spark, sf):
    h = g.growth_heatmap(b.nation_week(spark, sf), b.nation_industry(spark, sf))
    return rnd(h.withColumn("period", F.col("period").cast("long")))


@query("g11_heatmap_grid", oracle("SELECT industry, series, " + ", ".join(
  f"round(max(pct) FILTER (pos = (SELECT max(pos) FROM cal) - {i - 1}), 6) AS p{i}" for i in range(1, 13)) +
  " FROM pc JOIN cal USING (ts) JOIN flag_industry USING (series) WHERE pos > (SELECT max(pos) FROM cal) - 12 GROUP BY 1, 2",
  "flag_day", "flag_industry", ctes=_diff_sql("flag_day", 1, 0)))
def g11_grid(spark, sf):
    h = g.growth_heatmap(b.flag_day(spark, sf), b.flag_industry(spark, sf), "daily", "pop", n_periods=12)
    return rnd(g.heatmap_grid(h, 12))


def _band_body(panel, unit, n, hist):
    return f"""SELECT s.series, CAST(w AS INTEGER) AS slot, hist_min, hist_max, round(hist_mean, 6) AS hist_mean, this_year, last_year
      FROM (SELECT DISTINCT series FROM {panel}) s CROSS JOIN generate_series(1, {n}) t(w) LEFT JOIN (
      SELECT series, {unit}(ts) AS slot, min(value) FILTER (year(ts) < {hist}) AS hist_min, max(value) FILTER (year(ts) < {hist}) AS hist_max,
      avg(value) FILTER (year(ts) < {hist}) AS hist_mean, arg_max(value, ts) FILTER (year(ts) = 2001) AS this_year,
      arg_max(value, ts) FILTER (year(ts) = 2000) AS last_year FROM {panel} GROUP BY 1, 2) b ON b.series = s.series AND b.slot = w"""


def _band_sql(panel, unit, n, hist):
    return oracle(_band_body(panel, unit, n, hist), panel)


@query("g12_seasonal_week", _band_sql("nation_week", "week", 53, 2001))
def g12(spark, sf):
    return rnd(g.seasonal_band(b.nation_week(spark, sf), "week"))


@query("g13_seasonal_month", _band_sql("segment_month", "month", 12, 2000))
def g13(spark, sf):
    return rnd(g.seasonal_band(b.segment_month(spark, sf), "month", 2001))


def _fill(c):
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


@query("g14_seasonal_day", oracle(f"SELECT series, slot, {_fill('hist_min')}, {_fill('hist_max')}, {_fill('hist_mean')}, this_year, last_year FROM band",
  "flag_day", ctes={"band": _band_body("flag_day", "dayofyear", 366, 2000)}))
def g14(spark, sf):
    return rnd(g.seasonal_band(b.flag_day(spark, sf), "day"))


# ---------------------------------------------------------------- pivots

@query("p1_pivot_period", oracle("""SELECT CAST(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS key, sum(value) AS value_sum,
  round(avg(value), 6) AS value_mean, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max,
  round(stddev_samp(value), 6) AS value_std, round(var_samp(value), 4) AS value_var, median(value) AS value_median
  FROM brand_day GROUP BY 1""", "brand_day"))
def p1(spark, sf):
    return rnd(g.pivot_single(b.brand_day(spark, sf), "value", period="Q", aggs=list(g.AGGREGATES)), value_var=4)


@query("p1_pivot_category", oracle("""SELECT series AS key, sum(value) AS value_sum, round(avg(value), 6) AS value_mean,
  median(value) AS value_median FROM brand_day GROUP BY 1""", "brand_day"))
def p1c(spark, sf):
    return rnd(g.pivot_single(b.brand_day(spark, sf), "value", key="series", aggs=["sum", "mean", "median"]))


@query("p2_pivot_multi", oracle("""SELECT year, month, """ + ", ".join(
  f"sum(value) FILTER (l_flag = '{f}') AS \"{f}_value_sum\", round(avg(value) FILTER (l_flag = '{f}'), 6) AS \"{f}_value_mean\"" for f in "ANR") +
  """ FROM (SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, value, left(series, 1) AS l_flag FROM flag_day
  WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') GROUP BY 1, 2""", "flag_day"))
def p2(spark, sf):
    d = g.with_period_labels(b.flag_day(spark, sf), ["year", "month"]).withColumn("flag", F.substring("series", 1, 1))
    return rnd(g.pivot_multi(d, ["value"], ["year", "month"], "flag", ["A", "N", "R"], ["sum", "mean"],
                             "1996-01-01", "2000-12-31"))


@query("p3_period_labels", oracle("""SELECT ts, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
  strftime(ts, '%Y') || '-Q' || quarter(ts) AS quarter, strftime(ts, '%Y-W%U') AS week, sum(value) AS value FROM flag_day GROUP BY ALL""", "flag_day"))
def p3(spark, sf):
    d = g.with_period_labels(b.flag_day(spark, sf), ["year", "month", "quarter", "week"])
    return d.groupBy("ts", "year", "month", "quarter", "week").agg(F.sum("value").alias("value"))


@query("p4_pivot_grouped", oracle("""SELECT ts, """ + ", ".join(
  f"round(sum(value) FILTER (industry = '{i}'), 2) AS \"{i}\"" for i in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) +
  " FROM (SELECT ts, CAST(value AS DECIMAL(18,2))::DOUBLE AS value, industry FROM nation_week JOIN nation_industry USING (series)) GROUP BY 1",
  "nation_week", "nation_industry"))
def p4(spark, sf):
    m = b.nation_industry(spark, sf).withColumnRenamed("industry", "group")
    groups = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    out = g.pivot_grouped(b.nation_week(spark, sf), m, ["ts"], groups)
    return rnd(out, 2)


@query("p5_previous_period", oracle("""SELECT a.series, a.ts, a.value, p.value AS previous FROM nation_week a LEFT JOIN nation_week p
  ON a.series = p.series AND p.ts = a.ts - 364""", "nation_week"))
def p5(spark, sf):
    return g.previous_period(b.nation_week(spark, sf), 52, "W-FRI")


@query("p5_month_vs_last_year", oracle("""SELECT series, day(ts) AS slot, max(value) FILTER (year(ts) = year(m)) AS "current",
  max(value) FILTER (year(ts) = year(m) - 1) AS year_ago FROM flag_day, (SELECT max(ts) AS m FROM flag_day)
  WHERE month(ts) = month(m) AND year(ts) >= year(m) - 1 GROUP BY 1, 2""", "flag_day"))
def p5m(spark, sf):
    return g.same_period_last_year(b.flag_day(spark, sf), "month")


@query("p5_quarter_vs_last_year", oracle("""SELECT series, (month(ts) - 1) % 3 + 1 AS slot, max(value) FILTER (year(ts) = year(m)) AS "current",
  max(value) FILTER (year(ts) = year(m) - 1) AS year_ago FROM segment_month, (SELECT max(ts) AS m FROM segment_month)
  WHERE quarter(ts) = quarter(m) AND year(ts) >= year(m) - 1 GROUP BY 1, 2""", "segment_month"))
def p5q(spark, sf):
    return g.same_period_last_year(b.segment_month(spark, sf), "quarter")

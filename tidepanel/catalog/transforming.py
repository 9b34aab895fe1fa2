"""Transform queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import oracle, query, rnd
from tidepanel.catalog.frequency import _ALL as PANELS_OF_ALL_FREQUENCIES, _CODES as INFERENCE_SQL, _many as many
from tidepanel.operators import frequency as f
from tidepanel.operators import panel as p
from tidepanel.operators import transforms as t

_W = "(PARTITION BY series ORDER BY ts)"
_RUN = "(PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _dense(spark, sf):
    return p.densify(b.brand_week(spark, sf), "W-FRI")


def _on_dense(expr):
    return oracle(f"SELECT series, ts, {expr} AS value FROM dense", "brand_week", dense=("brand_week", "W"))


@query("t1_log", _on_dense("round(CASE WHEN value > 0 THEN ln(value) END, 6)"))
def t1(spark, sf):
    return rnd(t.transform(_dense(spark, sf), "log"))


@query("t2_exp_abs", oracle("""SELECT series, ts, round(exp(value / 1000.0), 6) AS e, abs(500 - value) AS a FROM dense""",
                            "brand_week", dense=("brand_week", "W")))
def t2(spark, sf):
    d = _dense(spark, sf)
    v = F.col("value")
    e = t.apply_transform(v / F.lit(1000.0), "exp", None)
    return rnd(d.select("series", "ts", e.alias("e"), t.apply_transform(F.lit(500.0) - v, "abs", None).alias("a")))


@query("t3_cumsum", _on_dense(f"CASE WHEN value IS NOT NULL THEN sum(value) OVER {_RUN} END"))
def t3(spark, sf):
    return t.transform(_dense(spark, sf), "cumsum")


@query("t4_cumprod", oracle(f"""SELECT series, ts, round(CASE WHEN value IS NOT NULL THEN exp(sum(ln(value)) OVER {_RUN}) END, 9) AS value FROM (
  SELECT series, ts, value / lag(value) OVER {_W} AS value FROM brand_week)""", "brand_week"))
def t4(spark, sf):
    d = b.brand_week(spark, sf)
    w = p.series_window()
    ratio = d.withColumn("value", F.try_divide(F.col("value"), F.lag("value").over(w)))
    return rnd(t.transform(ratio, "cumprod"), 9)


@query("t5_cummin_cummax", oracle(f"""SELECT series, ts, CASE WHEN value IS NOT NULL THEN min(value) OVER {_RUN} END AS lo,
  CASE WHEN value IS NOT NULL THEN max(value) OVER {_RUN} END AS hi FROM dense""", "brand_week", dense=("brand_week", "W")))
def t5(spark, sf):
    w, v = p.series_window(), F.col("value")
    return _dense(spark, sf).select("series", "ts", t.apply_transform(v, "cummin", w).alias("lo"), t.apply_transform(v, "cummax", w).alias("hi"))


@query("t6_diff", _on_dense(f"value - lag(value, 4) OVER {_W}"))
def t6(spark, sf):
    return t.transform(_dense(spark, sf), "diff", periods=4)


@query("t7_moving_average", _on_dense("round(avg(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6)"))
def t7(spark, sf):
    return rnd(t.transform(_dense(spark, sf), "moving_average", window=4))


@query("t8_growth_rate", _on_dense(f"round((value - lag(value, 52) OVER {_W}) / nullif(lag(value, 52) OVER {_W}, 0), 6)"))
def t8(spark, sf):
    return rnd(t.transform(_dense(spark, sf), "growth_rate", periods=52))


@query("t9_growth_periods", oracle("""SELECT series, CASE WHEN freq_code LIKE 'Q%' THEN 4 WHEN freq_code LIKE 'M%' THEN 12 WHEN freq_code LIKE 'W%' THEN 52
  WHEN freq_code LIKE 'D%' OR freq_code LIKE 'B%' THEN 365 ELSE 1 END AS yoy, 1 AS pop FROM inf""", *PANELS_OF_ALL_FREQUENCIES, ctes=INFERENCE_SQL))
def t9(spark, sf):
    d = f.infer_frequency(many(spark, sf))
    return d.select("series", t.growth_periods(F.col("freq_code")).alias("yoy"), t.growth_periods(F.col("freq_code"), False).alias("pop"))


@query("t10_constant", oracle("""SELECT series, ts, value + 3 AS plus, value - 3 AS minus, value * 2.5 AS times, round(value / 7.0, 6) AS over,
  CAST(NULL AS DOUBLE) AS by_zero FROM dense""", "brand_week", dense=("brand_week", "W")))
def t10(spark, sf):
    v = F.col("value")
    pick = [("plus", "add", 3), ("minus", "subtract", 3), ("times", "multiply", 2.5), ("over", "divide", 7), ("by_zero", "divide", 0)]
    return rnd(_dense(spark, sf).select("series", "ts", *[t.apply_transform(v, k, None, constant=x).alias(n) for n, k, x in pick]))


@query("t11_transform_chain", oracle("""SELECT series, ts, round(value, 6) AS value FROM m
  UNION ALL SELECT series || '_Diff_1', ts, round(d1, 6) FROM m
  UNION ALL SELECT series || '_YoY_52p', ts, round(y, 6) FROM m
  UNION ALL SELECT series || '_Diff_1_Moving Average_4', ts, round(ma, 6) FROM m""",
  "brand_week", dense=("brand_week", "W"), ctes={
    "d": "SELECT * FROM dense WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    "s": f"""SELECT series, ts, value, value - lag(value) OVER {_W} AS d1,
      (value - lag(value, 52) OVER {_W}) / nullif(lag(value, 52) OVER {_W}, 0) AS y FROM d""",
    "m": """SELECT *, avg(d1) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ma FROM s"""}))
def t11(spark, sf):
    steps = [{"kind": "diff", "periods": 1}, {"kind": "growth_rate", "periods": 52, "yoy": True},
             {"kind": "moving_average", "window": 4, "of": 0}]
    return rnd(t.transform_chain(_dense(spark, sf), steps, "1996-01-01", "2000-12-31"))


@query("t12_log_axis", _on_dense("round(CASE WHEN value > 0 THEN log10(value) END, 6)"))
def t12(spark, sf):
    return rnd(t.transform(_dense(spark, sf), "log10"))


@query("t13_weighted_sum", oracle("""SELECT industry AS series, ts, round(CASE WHEN count(value) = max(n) THEN sum(value * w) END, 4) AS value FROM
  nation_week JOIN (SELECT series, industry, (CAST(substr(series, 8) AS INTEGER) + 1) AS w0, sum(CAST(substr(series, 8) AS INTEGER) + 1) OVER (PARTITION BY industry) AS tot,
  (CAST(substr(series, 8) AS INTEGER) + 1) * 1.0 / sum(CAST(substr(series, 8) AS INTEGER) + 1) OVER (PARTITION BY industry) AS w, count(*) OVER (PARTITION BY industry) AS n
  FROM nation_industry) USING (series) GROUP BY 1, 2""", "nation_week", "nation_industry"))
def t13(spark, sf):
    w = b.nation_industry(spark, sf).select(F.col("industry").alias("label"), "series",
                                            (F.substring_index("series", "_", -1).cast("double") + 1).alias("weight"))
    return rnd(t.weighted_sum(b.nation_week(spark, sf), t.normalized_weights(w, ["label"])), 4)


#: All brands: added and taken away in turn with growing weights, divided by the last.
_TERMS = [("-" if i % 2 == 0 else "+", f"Brand#{i}", i / 100) for i in range(1, 25)] + [("/", "Brand#25", 1.0)]
_TERMS_SQL = " ".join(f"{op} {w} * x{i}" for i, (op, _, w) in enumerate(_TERMS[:-1]))[1:]


@query("t13_weighted_formula", oracle(f"""SELECT 'mix' AS series, ts, round(({_TERMS_SQL}) / nullif(1.0 * x24, 0), 6) AS value FROM (SELECT ts,
  {", ".join(f"max(value) FILTER (series = '{name}') AS x{i}" for i, (_, name, _) in enumerate(_TERMS))} FROM brand_week GROUP BY 1)""", "brand_week"))
def t13f(spark, sf):
    return rnd(t.weighted_formula(b.brand_week(spark, sf), "mix", _TERMS))


@query("t14_group_arithmetic", oracle("""SELECT l.series || '/' || r.series AS series, coalesce(l.ts, r.ts) AS ts, round(l.value / nullif(r.value, 0), 6) AS value
  FROM (SELECT * FROM nation_week WHERE series <> 'NATION_0') l JOIN (SELECT * FROM nation_week WHERE series = 'NATION_0') r USING (ts)""",
  "nation_week"))
def t14(spark, sf):
    d = b.nation_week(spark, sf)
    n = b.nation_industry(spark, sf).select("series").filter("series <> 'NATION_0'")
    pairs = n.select(F.concat("series", F.lit("/NATION_0")).alias("name"), F.col("series").alias("left"), F.lit("NATION_0").alias("right"))
    return rnd(t.group_arithmetic(d, pairs, "/").filter(F.col("value").isNotNull()))


@query("t15_within_period", oracle("""SELECT series, ts, sum(value) OVER (PARTITION BY series, date_trunc('quarter', ts) ORDER BY ts) AS cum,
  value - lag(value) OVER (PARTITION BY series, date_trunc('quarter', ts) ORDER BY ts) AS step,
  round(avg(value) OVER (PARTITION BY series, date_trunc('quarter', ts) ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS roll FROM brand_week""", "brand_week"))
def t15(spark, sf):
    d = b.brand_week(spark, sf).withColumn("raw", F.col("value"))
    d = t.within_period(d, "Q", "sum").withColumnRenamed("value", "cum").withColumn("value", F.col("raw"))
    d = t.within_period(d, "Q", "diff", periods=1).withColumnRenamed("value", "step").withColumn("value", F.col("raw"))
    d = t.within_period(d, "Q", "rolling", window=3).withColumnRenamed("value", "roll")
    return rnd(d.select("series", "ts", "cum", "step", "roll"))


@query("t16_base_year_growth", oracle("""SELECT y.series, y.ts, round((y.value - z.value) / z.value, 6) AS value FROM yr y JOIN yr z ON y.series = z.series AND year(z.ts) = 1996""",
  "brand_day", ctes={"yr": "SELECT series, make_date(year(ts), 12, 31) AS ts, sum(value) AS value FROM brand_day GROUP BY 1, 2"}))
def t16(spark, sf):
    yearly = f.resample(b.brand_day(spark, sf), "A", "sum")
    return rnd(t.base_year_growth(yearly, 1996))


@query("t17_standardise", oracle("""SELECT series, ts, round((value - avg(value) OVER (PARTITION BY series)) / stddev_samp(value) OVER (PARTITION BY series), 6) AS z
  FROM nation_week""", "nation_week"))
def t17(spark, sf):
    return rnd(t.standardise(b.nation_week(spark, sf)).select("series", "ts", "z"))


@query("t18_rescale", oracle("""SELECT series, ts, round(value, 2) AS value FROM nation_week""", "nation_week"))
def t18(spark, sf):
    d = t.standardise(b.nation_week(spark, sf))
    return rnd(d.select("series", "ts", t.rescale(F.col("z"), F.col("mean"), F.col("std")).alias("value")), 2)


@query("t19_mask_months", oracle("""SELECT series, ts, CASE WHEN series = 'NATION_0' AND month(ts) IN (1, 2) THEN NULL ELSE value END AS value FROM nation_week""", "nation_week"))
def t19(spark, sf):
    return t.mask_months(b.nation_week(spark, sf), "NATION_0")


@query("t20_apply_rules", oracle(f"""SELECT series, ts, round(CASE rule WHEN 'log_diff' THEN ln(value) - lag(ln(value)) OVER {_W}
  WHEN 'diff' THEN value - lag(value) OVER {_W} ELSE value END, 6) AS value FROM (SELECT *, CASE CAST(substr(series, 8) AS INTEGER) % 3
  WHEN 0 THEN 'level' WHEN 1 THEN 'diff' ELSE 'log_diff' END AS rule FROM nation_week)""", "nation_week"))
def t20(spark, sf):
    k = F.substring_index("series", "_", -1).cast("int") % 3
    rules = b.nation_industry(spark, sf).select("series", F.when(k == 0, "level").when(k == 1, "diff").otherwise("log_diff").alias("status"))
    return rnd(t.apply_rules(b.nation_week(spark, sf), rules))

"""Factor model, nowcast, news and attribution queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import W_FRI, oracle, query, r, rnd
from tidepanel.operators import factor as fa
from tidepanel.operators import growth as g
from tidepanel.operators import nowcast as n
from tidepanel.operators import panel as p
from tidepanel.operators import prepare as pr
from tidepanel.operators import properties as pp
from tidepanel.plans.session import cut_lineage

TARGET, K = "NATION_0", 2
DAYS = {"train_end": "1999-12-31", "oos_start": "2000-01-01", "oos_end": "2001-06-29"}


def _obs(spark, sf):
    """The weekly panel, written once per query: what reads it again does not join the tables again."""
    return cut_lineage(b.nation_week(spark, sf)).select(F.lit("all").alias("panel"), "series", "ts", "value")


def _model(obs):
    """A fit with the default number of iterations; every query below fits anew."""
    return fa.fit_dfm(obs, K)


# ---------------------------------------------------------------- mixed-frequency panel

def _inputs(spark, sf):
    return {"target": b.segment_month(spark, sf).filter("series = 'BUILDING'"),
            "target_sheet": b.segment_month(spark, sf).filter("series <> 'BUILDING'"),
            "monthly": b.brand_month(spark, sf), "daily": b.flag_day(spark, sf), "weekly": b.nation_week(spark, sf)}


@query("r13_mixed_freq_panel")
def r13(spark, sf):
    return rnd(pr.mixed_freq_panel(_inputs(spark, sf), "1996-01-05", "2001-06-29")[0], 4)


@query("r13_transform_log")
def r13_log(spark, sf):
    return rnd(pr.mixed_freq_panel(_inputs(spark, sf), "1996-01-05", "2001-06-29", {"monthly": 6, "weekly": 30})[1], 4)


# A level above 1 keeps every series as it is, so the alignment has SQL.
@query("r13_aligned_levels", oracle("""SELECT s.series, c.ts, round(v.value, 4) AS value, s.role FROM (SELECT DISTINCT series, role FROM every WHERE ts BETWEEN (SELECT a FROM bounds) AND (SELECT z FROM bounds)) s
  CROSS JOIN (SELECT CAST(g AS DATE) AS ts FROM bounds, generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY) t(g)) c LEFT JOIN every v ON v.series = s.series AND v.ts = c.ts""",
  "segment_month", "brand_month", "flag_day", "nation_week", ctes={
    "every": """SELECT series, CAST(date_trunc('week', ts) + INTERVAL 4 DAY AS DATE) AS ts, value, CASE WHEN series = 'BUILDING' THEN 'target' ELSE 'target_sheet' END AS role FROM segment_month
  UNION ALL SELECT series, CAST(ts - CAST((isodow(ts) + 2) % 7 AS INTEGER) AS DATE), value, 'monthly' FROM brand_month
  UNION ALL SELECT series, CAST(ts + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE), avg(value), 'daily' FROM flag_day GROUP BY 1, 2
  UNION ALL SELECT series, ts, value, 'weekly' FROM nation_week""",
    "bounds": """SELECT greatest(lo - CAST((isodow(lo) + 2) % 7 AS INTEGER), DATE '1996-01-05') AS a, least(hi, DATE '2001-06-29') AS z FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM every)"""}))
def r13_levels(spark, sf):
    return rnd(pr.mixed_freq_panel(_inputs(spark, sf), "1996-01-05", "2001-06-29", alpha=1.1)[0], 4)


@query("r14_check_alignment", oracle("""SELECT series, ts, value, status FROM (SELECT p.series, p.ts, max(p.value) AS value,
    CASE WHEN max(q.value) IS NULL THEN 'unexpected' WHEN NOT bool_or(abs(p.value - q.value) <= 1e-6 + 1e-6 * abs(q.value)) THEN 'misaligned' ELSE 'ok' END AS status
  FROM prep p LEFT JOIN rawf q USING (series, ts) GROUP BY 1, 2) WHERE status <> 'ok'
  UNION ALL SELECT DISTINCT q.series, q.ts, CAST(NULL AS DOUBLE), 'missing' FROM rawf q JOIN (SELECT series, min(ts) AS lo, max(ts) AS hi FROM prep GROUP BY 1) s USING (series)
    WHERE q.ts BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM prep p WHERE p.series = q.series AND p.ts = q.ts)""", "brand_day", ctes={
      "rawf": "SELECT series, CAST(ts + CAST(5 - isodow(ts) AS INTEGER) AS DATE) AS ts, value FROM brand_day",
      "prep": f"""SELECT series, ts, value FROM (SELECT series, {W_FRI.replace('isodow(d)', 'isodow(ts)').replace('d +', 'ts +')} AS ts, value, ts AS day FROM brand_day)
        QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY day DESC) = 1"""}))
def r14(spark, sf):
    from tidepanel.operators.frequency import to_weekly_friday

    d = b.brand_day(spark, sf)
    return pr.check_alignment(to_weekly_friday(d, "weekly", dense=False), d)


# ---------------------------------------------------------------- components and fit

@query("n1_pca_variance")
def n1(spark, sf):
    return rnd(fa.pca_variance(_obs(spark, sf)))


@query("n2_select_k")
def n2(spark, sf):
    obs = _obs(spark, sf)
    pca = cut_lineage(fa.pca_variance(obs))
    out = None
    for how in ("cumulative", "elbow", "kaiser", "bai_ng"):
        d = fa.select_k(pca, how).select(F.lit(how).alias("method"), F.col("k").cast("int").alias("k"))
        out = d if out is None else out.unionByName(d)
    load = _model(obs)["loadings"]
    return out.unionByName(fa.select_k(pca, "common", None, load, TARGET).select(F.lit("common").alias("method"), F.col("k").cast("int").alias("k")))


_SPECTRUM = {"sp": "SELECT row_number() OVER (ORDER BY v DESC, series) AS k, v / avg(v) OVER () AS e, count(*) OVER () AS n FROM (SELECT series, var_samp(value) AS v FROM nation_week GROUP BY 1)",
             "cu": """SELECT *, sum(e) OVER () AS total, sum(e) OVER (ORDER BY k) AS cum, lead(e) OVER (ORDER BY k) AS nx, (SELECT count(DISTINCT ts) FROM nation_week) AS t FROM sp""",
             "ic": "SELECT k, ln(t * (total - cum) / (n * t)) + k * (n + t)::DOUBLE / (n * t) * ln(least(n, t)) AS ic FROM cu WHERE k < least(n, t) AND t * (total - cum) > 1e-9"}


@query("n2_select_k_given_spectrum", oracle("""SELECT 'cumulative' AS method, CAST(coalesce(min(k) FILTER (100 * cum / total >= 90), max(k)) AS INTEGER) AS k FROM cu
  UNION ALL SELECT 'elbow', CAST(coalesce(min(k) FILTER (abs((nx - e) / e) < 0.1), max(k)) AS INTEGER) FROM cu
  UNION ALL SELECT 'kaiser', CAST(greatest(count(*) FILTER (e > 1), 1) AS INTEGER) FROM cu
  UNION ALL SELECT 'bai_ng', CAST(arg_min(k, ic) AS INTEGER) FROM ic""", "nation_week", ctes=_SPECTRUM))
def n2_given(spark, sf):
    """The counting rules on a spectrum both engines can make: the series' variances."""
    o = b.nation_week(spark, sf)
    w = p.Window.orderBy(F.col("v").desc(), "series")  # one row per series
    d = o.groupBy("series").agg(F.var_samp("value").alias("v"))
    d = d.select(F.row_number().over(w).alias("k"), F.try_divide("v", F.avg("v").over(p.Window.partitionBy())).alias("eigenvalue"), F.count(F.lit(1)).over(p.Window.partitionBy()).alias("n_series"))
    total = F.sum("eigenvalue").over(p.Window.partitionBy())
    cum = F.sum("eigenvalue").over(p.Window.orderBy("k").rowsBetween(p.Window.unboundedPreceding, 0))
    pca = cut_lineage(d.select(F.lit("all").alias("panel"), "k", "eigenvalue", "n_series", total.alias("total_variance"), (100 * cum / total).alias("cumulative_pct"),
                               o.agg(F.count_distinct("ts")).scalar().alias("n_t")))
    out = None
    for how in ("cumulative", "elbow", "kaiser", "bai_ng"):
        one = fa.select_k(pca, how).select(F.lit(how).alias("method"), F.col("k").cast("int").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


@query("n3_init_factors")
def n3(spark, sf):
    f, _, _ = fa.init_factors(fa.model_panel(_obs(spark, sf)), K)
    return rnd(f.select("panel", "t", F.posexplode("f").alias("factor", "score")))


@query("n4_kalman_smoother")
def n4(spark, sf):
    m = _model(_obs(spark, sf))
    return rnd(m["filtered"].select("panel", "ts", F.posexplode("x").alias("factor", "state")))


@query("n5_fit_loadings")
def n5(spark, sf):
    return rnd(n.loading_rows(_model(_obs(spark, sf))["loadings"]), 4)


@query("n6_reconstruct")
def n6(spark, sf):
    m = _model(_obs(spark, sf))
    return rnd(fa.reconstruct(m["smoothed"], m["loadings"]), 2)


@query("n7_evaluate_model")
def n7(spark, sf):
    return rnd(fa.evaluate_models(_obs(spark, sf), TARGET, K, **DAYS)[0], 4)


PREDICTORS = [f"NATION_{i}" for i in range(1, 25)]


def _removals(spark, steps):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(steps)], "step int, block string, removed string, hit_rate double, rmse double, k int").withColumns(
        {"hit_rate": F.round("hit_rate", 4), "rmse": F.round("rmse", 4)})


@query("n8_backward_select")
def n8_select(spark, sf):
    """Global selection to its end: the removals with score and factor count."""
    steps = fa.backward_select(b.nation_week(spark, sf), TARGET, PREDICTORS, K, **DAYS)[1]
    return _removals(spark, [("all", *s) for s in steps])


@query("n8_backward_select_blocks")
def n8_blocks(spark, sf):
    """Block after block to the end; the blocks are the nations' regions."""
    of = {r[0]: r[1] for r in b.table(spark, sf, "nation").select(F.concat(F.lit("NATION_"), "n_nationkey"), F.col("n_regionkey").cast("string")).collect()}
    blocks = {}
    for v in PREDICTORS:
        blocks.setdefault(of[v], []).append(v)
    log = fa.backward_select_blocks(b.nation_week(spark, sf), TARGET, blocks, K, **DAYS)[1]
    return _removals(spark, [(block, *s) for block in sorted(log) for s in log[block]])


@query("n8_backward_select_grid")
def n8_grid(spark, sf):
    """Global selection over factor counts 1 and 2."""
    steps = fa.backward_select(b.nation_week(spark, sf), TARGET, PREDICTORS, (1, 2), **DAYS)[1]
    return _removals(spark, [("all", *s) for s in steps])


@query("n8_candidate_round")
def n8(spark, sf):
    """One round of backward selection: every candidate model in one job."""
    o = b.nation_week(spark, sf)
    names = F.array(*[F.lit(f"NATION_{i}") for i in range(1, 25)])
    d = o.select("series", "ts", "value", F.explode(names).alias("panel")).filter((F.col("panel") != F.col("series")))
    return rnd(fa.evaluate_models(d, TARGET, K, **DAYS)[0], 4)


# ---------------------------------------------------------------- metrics

_NC = {"nc": "SELECT ts, value AS nowcast, date_trunc('month', ts) AS m FROM nation_week WHERE series = 'NATION_5'",
       "tg": "SELECT m, target, lag(target) OVER (ORDER BY m) AS prev FROM (SELECT date_trunc('month', ts) AS m, arg_max(value, ts) / 20 AS target FROM segment_month WHERE series = 'BUILDING' GROUP BY 1)",
       "jj": "SELECT nc.*, target, prev, CASE WHEN prev IS NOT NULL THEN CASE WHEN sign(target - prev) = sign(nowcast - prev) THEN 1 ELSE 0 END END AS hit FROM nc JOIN tg USING (m)",
       "hm": "SELECT m, avg(hit) AS h FROM jj GROUP BY 1"}


def _nowcast_inputs(spark, sf):
    now = b.nation_week(spark, sf).filter("series = 'NATION_5'").select(F.lit("m").alias("panel"), "ts", "value")
    goal = b.segment_month(spark, sf).filter("series = 'BUILDING'").select("ts", (F.col("value") / 20).alias("value"))
    return now, goal


@query("n9_nowcast_metrics", oracle(f"""SELECT 'm' AS panel, {r("sqrt(avg((nowcast - target) * (nowcast - target)) FILTER (ts <= DATE '1999-12-31'))", 'is_rmse', 4)},
  {r("sqrt(avg((nowcast - target) * (nowcast - target)) FILTER (ts BETWEEN DATE '2000-01-01' AND DATE '2001-06-29'))", 'oos_rmse', 4)},
  {r("avg(abs(nowcast - target)) FILTER (ts <= DATE '1999-12-31')", 'is_mae', 4)}, {r("avg(abs(nowcast - target)) FILTER (ts BETWEEN DATE '2000-01-01' AND DATE '2001-06-29')", 'oos_mae', 4)},
  (SELECT {r("avg(h) FILTER (last_day(m) <= DATE '1999-12-31') * 100", 'x', 4)} FROM hm) AS is_hit_rate,
  (SELECT {r("avg(h) FILTER (last_day(m) BETWEEN DATE '2000-01-01' AND DATE '2001-06-29') * 100", 'x', 4)} FROM hm) AS oos_hit_rate FROM jj""", "nation_week", "segment_month", ctes=_NC))
def n9(spark, sf):
    now, goal = _nowcast_inputs(spark, sf)
    return rnd(n.nowcast_metrics(now, goal, **DAYS), 4)


_LF = {"lf": "SELECT date_trunc('month', ts) AS m, max(ts) AS ts, arg_max(value, ts) AS nowcast FROM nation_week WHERE series = 'NATION_5' GROUP BY 1",
       "tg": "SELECT date_trunc('month', ts) AS m, arg_min(value, ts) / 20 AS target FROM segment_month WHERE series = 'BUILDING' GROUP BY 1",
       "jj": "SELECT *, CASE WHEN ts <= DATE '2000-06-30' THEN 'is' ELSE 'oos' END AS s FROM lf JOIN tg USING (m)",
       "hh": """SELECT *, CASE WHEN lag(target) OVER w IS NOT NULL THEN CASE WHEN sign(target - lag(target) OVER w) = sign(nowcast - lag(nowcast) OVER w) THEN 1 ELSE 0 END END AS hit
         FROM jj WINDOW w AS (PARTITION BY s ORDER BY ts)"""}


@query("n10_month_last_friday_metrics", oracle("SELECT 'm' AS panel, " + ", ".join(
  f"round(sqrt(avg((nowcast - target) * (nowcast - target)) FILTER (s = '{s}')), 4) AS {s}_rmse, round(avg(abs(nowcast - target)) FILTER (s = '{s}'), 4) AS {s}_mae, "
  f"round(avg(hit) FILTER (s = '{s}') * 100, 4) AS {s}_hit_rate" for s in ("is", "oos")) + " FROM hh", "nation_week", "segment_month", ctes=_LF))
def n10(spark, sf):
    now, goal = _nowcast_inputs(spark, sf)
    return rnd(n.month_last_friday_metrics(now, goal, "2000-06-30"), 4)


@query("n11_aligned_nowcast_table", oracle("""SELECT n.ts, n.value AS nowcast, t.target FROM (SELECT * FROM nation_week WHERE series = 'NATION_5') n
  LEFT JOIN (SELECT lf.ts, target FROM lf JOIN (SELECT m - INTERVAL 1 MONTH AS m, target FROM (SELECT date_trunc('month', ts) AS m, arg_max(value, ts) / 20 AS target FROM segment_month WHERE series = 'BUILDING' GROUP BY 1)) USING (m)) t ON t.ts = n.ts""",
  "nation_week", "segment_month", ctes=_LF))
def n11(spark, sf):
    now, goal = _nowcast_inputs(spark, sf)
    return n.aligned_nowcast_table(now, goal)


@query("n12_forecast_to_month_end")
def n12(spark, sf):
    return rnd(n.forecast_to_month_end(_model(_obs(spark, sf)), TARGET, K), 2)


@query("n13_state_forecast")
def n13(spark, sf):
    d = n.state_forecast(_model(_obs(spark, sf)), K, 8)
    return rnd(d.select("panel", "h", "ts", F.posexplode("x").alias("factor", "state")))


def _vintages(o):
    """The panel as known at the end and as known some weeks before, when one
    week's values were still preliminary."""
    new = o.select(F.lit("now").alias("panel"), "series", "ts", "value")
    old = o.filter(F.col("ts") <= F.lit("2001-09-28").cast("date"))
    soft = F.when(F.col("ts") == F.lit("2001-09-21").cast("date"), F.col("value") * 0.9).otherwise(F.col("value"))
    return new, old.select(F.lit("before").alias("panel"), "series", "ts", soft.alias("value"))


@query("n14_apply_vintage")
def n14(spark, sf):
    obs = _obs(spark, sf)
    new, old = _vintages(obs)
    out = n.apply_vintage(_model(obs), new.unionByName(old), K)
    return rnd(out["filtered"].select("panel", "ts", F.posexplode("x").alias("factor", "state")))


@query("n15_news")
def n15(spark, sf):
    obs = _obs(spark, sf)
    new, old = _vintages(obs)
    m = _model(obs)
    now, before = n.apply_vintage(m, new, K, interpolate=False), n.apply_vintage(m, old, K, interpolate=False)
    return rnd(n.news(now, before, TARGET, "2001-11-09", K), 4)


@query("n16_nowcast_evolution")
def n16(spark, sf):
    return rnd(n.nowcast_evolution(n.forecast_to_month_end(_model(_obs(spark, sf)), TARGET, K), "2001-10"), 2)


@query("n17_news_by_industry")
def n17(spark, sf):
    dim = b.nation_industry(spark, sf)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return rnd(n.news_by_industry(_model(_obs(spark, sf)), TARGET, 1.0, "2001-10", dim, names, K), 4)


# ---------------------------------------------------------------- attribution
# The factor scores of these queries are weekly totals per return flag, so that
# the regressions have a plain SQL form.

_SC = {"fw": f"""SELECT {W_FRI} AS ts, l_returnflag AS fl, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 100 AS score FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY 1, 2""",
       "sc": "SELECT ts, CASE fl WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS factor, score FROM fw",
       "vf": "SELECT series, factor, p.value / 1000 AS value, score FROM nation_week p JOIN sc USING (ts)",
       "gs": """SELECT series, factor, count(*) AS n, regr_sxx(value, score) AS sxx, regr_syy(value, score) AS syy, regr_sxy(value, score) AS sxy FROM vf GROUP BY 1, 2"""}


def _flag_scores(spark, sf):
    li = b.table(spark, sf, "lineitem")
    from tidepanel.functions.calendar import bin_label

    d = li.groupBy(bin_label(F.col("l_shipdate"), "W-FRI").alias("ts"), F.col("l_returnflag").alias("fl")).agg((b.exact_sum("l_quantity") / 100).alias("score"))
    return d.select("ts", F.when(F.col("fl") == "A", 1).when(F.col("fl") == "N", 2).otherwise(3).alias("factor"), "score")


def _data(spark, sf):
    return b.nation_week(spark, sf).withColumn("value", F.col("value") / 1000)


def _types(spark, sf):
    return b.nation_industry(spark, sf).withColumn("type", F.substring("industry", 1, 1))


def _two(spark, sf):
    """Data and two factors with positions, as :func:`factor_products` needs them."""
    s = _flag_scores(spark, sf)
    wide = s.groupBy("ts").agg(F.max(F.when(F.col("factor") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("factor") == 2, F.col("score"))).alias("c"))
    from tidepanel.functions.calendar import bin_ordinal

    t = bin_ordinal(F.col("ts"), "W-FRI").alias("t")
    f = wide.filter("a is not null and c is not null").select(F.lit("m").alias("panel"), t, F.array("a", "c").alias("f"))
    return _data(spark, sf).select(F.lit("m").alias("panel"), "series", t, "value"), f


_TWO = {**_SC, "w2": "SELECT ts, max(score) FILTER (factor = 1) AS a, max(score) FILTER (factor = 2) AS c FROM sc GROUP BY 1 HAVING a IS NOT NULL AND c IS NOT NULL",
        "s2": """SELECT series, count(*) AS n, var_pop(a) AS saa, var_pop(c) AS scc, covar_pop(a, c) AS sac, covar_pop(a, v) AS sav, covar_pop(c, v) AS scv, var_pop(v) AS svv
          FROM (SELECT series, value / 1000 AS v, a, c FROM nation_week JOIN w2 USING (ts)) GROUP BY 1""",
        "bb": "SELECT *, (sav * scc - scv * sac) / (saa * scc - sac * sac) AS b1, (scv * saa - sav * sac) / (saa * scc - sac * sac) AS b2 FROM s2"}


@query("n18_factor_contribution", oracle("""SELECT 'm' AS panel, factor, round(l, 6) AS loading, round(l * l, 6) AS squared_loading, round(100 * l * l / (b1 * b1 + b2 * b2), 6) AS common_pct, round(100 * l * l / svv, 6) AS total_pct
  FROM (SELECT 1 AS factor, b1 AS l, * FROM bb UNION ALL SELECT 2, b2, * FROM bb) WHERE series = 'NATION_0'""", "nation_week", ctes=_TWO))
def n18(spark, sf):
    data, f = _two(spark, sf)
    return rnd(n.factor_contribution(data, f, TARGET, 2))


@query("n19_variable_r2", oracle("SELECT series, factor, n, round(sxy * sxy / (sxx * syy), 6) AS r2 FROM gs", "nation_week", ctes=_SC))
def n19(spark, sf):
    return rnd(n.variable_r2(_data(spark, sf), _flag_scores(spark, sf)))


@query("n20_industry_r2", oracle("""SELECT 'm' AS panel, industry, count(*) AS n_series, round(1 - sum(n * (svv - b1 * sav - b2 * scv)) / sum(n * svv), 6) AS r2
  FROM bb JOIN nation_industry USING (series) WHERE n >= 4 GROUP BY 2""", "nation_week", "nation_industry", ctes=_TWO))
def n20(spark, sf):
    data, f = _two(spark, sf)
    return rnd(n.industry_r2(data, f, b.nation_industry(spark, sf), 2))


def _pooled(col):
    return f"""SELECT {col}, factor, count(*) AS n_series, greatest(0.0, 1 - sum(syy - sxy * sxy / sxx) / sum(syy)) AS r2
      FROM gs JOIN (SELECT *, left(industry, 1) AS type FROM nation_industry) USING (series) WHERE n >= 3 GROUP BY 1, 2"""


@query("n21_factor_industry_r2", oracle(f"SELECT industry, factor, n_series, round(r2, 6) AS r2 FROM ({_pooled('industry')})", "nation_week", "nation_industry", ctes=_SC))
def n21(spark, sf):
    return rnd(n.group_factor_r2(_data(spark, sf), _flag_scores(spark, sf), b.nation_industry(spark, sf)))


@query("n21_factor_type_r2", oracle(f"SELECT type, factor, n_series, round(r2, 6) AS r2 FROM ({_pooled('type')})", "nation_week", "nation_industry", ctes=_SC))
def n21t(spark, sf):
    return rnd(n.group_factor_r2(_data(spark, sf), _flag_scores(spark, sf), _types(spark, sf), "type"))


@query("n22_driving_factor", oracle(f"SELECT industry, factor, round(r2, 6) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY r2 DESC, factor) AS rn FROM ({_pooled('industry')})) WHERE rn = 1",
                                    "nation_week", "nation_industry", ctes=_SC))
def n22(spark, sf):
    return rnd(n.driving_factor(n.group_factor_r2(_data(spark, sf), _flag_scores(spark, sf), b.nation_industry(spark, sf))))


_LOAD = {**_SC, "ld": "SELECT series, factor, sxy / sxx AS loading FROM gs"}


def _loads(data, scores):
    d = data.join(scores, "ts").groupBy("series", "factor").agg(F.regr_slope("value", "score").alias("loading"))
    return d


@query("n23_top_loadings", oracle("SELECT series, factor, round(loading, 6) AS loading, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY abs(loading) DESC, series) AS rn FROM ld) WHERE rn <= 5",
                                  "nation_week", ctes=_LOAD))
def n23(spark, sf):
    return rnd(n.top_loadings(_loads(_data(spark, sf), _flag_scores(spark, sf)), 5)[0].select("series", "factor", "loading", "rank"))


@query("n24_loading_groups")
def n24(spark, sf):
    return n.loading_groups(_model(_obs(spark, sf))["loadings"], 4).select("series", "group")


@query("n24_clear_groups", oracle("SELECT series, min(series) OVER (PARTITION BY industry) AS first_of_group FROM nation_industry", "nation_industry"))
def n24_clear(spark, sf):
    """Loadings that form one tight group per region; groups are named by their first series."""
    d = b.nation_industry(spark, sf)
    r = F.ascii(F.substring("industry", 2, 1))  # F, M, S, U and I
    near = F.ascii(F.substring("series", -1, 1)) / 1000.0
    load = d.select("series", F.array(r * 100.0 + near, r % 7 * 50.0 - near).alias("l"))
    out = n.loading_groups(load, 5)
    return out.select("series", F.min("series").over(p.Window.partitionBy("group")).alias("first_of_group"))


_STAB = {**_SC, "lf": "SELECT series, factor, regr_slope(value, score) AS x FROM vf GROUP BY 1, 2",
         "lt": "SELECT series, factor, regr_slope(p.value / 1000, score) AS y FROM nation_week p JOIN sc USING (ts) WHERE ts <= DATE '1999-12-31' GROUP BY 1, 2"}


@query("n25_loading_stability", oracle("""SELECT a.factor AS factor_full, z.factor AS factor_train, round(corr(x, y), 6) AS corr FROM lf a JOIN lt z USING (series) GROUP BY 1, 2""", "nation_week", ctes=_STAB))
def n25(spark, sf):
    d, s = _data(spark, sf), _flag_scores(spark, sf)
    train = d.filter(F.col("ts") <= F.lit("1999-12-31").cast("date"))
    return rnd(n.loading_stability(_loads(d, s), _loads(train, s))[0])


@query("n25_matched_factors", oracle("""SELECT f AS factor_full, t AS factor_train, round(c, 6) AS corr, c < 0 AS flip FROM cc, best WHERE (f = 1 AND t = t1) OR (f = 2 AND t = t2) OR (f = 3 AND t = t3)""",
  "nation_week", ctes={**_STAB, "cc": "SELECT a.factor AS f, z.factor AS t, corr(x, y) AS c FROM lf a JOIN lt z USING (series) GROUP BY 1, 2",
    "best": """SELECT x.t AS t1, y.t AS t2, z.t AS t3 FROM cc x, cc y, cc z WHERE x.f = 1 AND y.f = 2 AND z.f = 3 AND x.t <> y.t AND x.t <> z.t AND y.t <> z.t
      ORDER BY x.c + y.c + z.c DESC LIMIT 1"""}))
def n25m(spark, sf):
    d, s = _data(spark, sf), _flag_scores(spark, sf)
    train = d.filter(F.col("ts") <= F.lit("1999-12-31").cast("date"))
    return rnd(n.loading_stability(_loads(d, s), _loads(train, s))[1])


@query("n26_variable_blocks", oracle("""SELECT coalesce(CASE WHEN industry <> 'ASIA' THEN left(industry, 1) END, industry, '其他') AS block, series
  FROM nation_industry""", "nation_industry"))
def n26(spark, sf):
    dim = _types(spark, sf).withColumn("type", F.when(F.col("industry") != "ASIA", F.col("type")))
    return n.block_members(n.variable_blocks(dim)[0])


@query("n26_factor_count_hint", oracle("""SELECT greatest(count(DISTINCT industry), count(DISTINCT coalesce(CASE WHEN industry <> 'ASIA' THEN left(industry, 1) END, industry))) + 1 AS k FROM nation_industry""", "nation_industry"))
def n26k(spark, sf):
    dim = _types(spark, sf).withColumn("type", F.when(F.col("industry") != "ASIA", F.col("type")))
    return n.variable_blocks(dim)[1]


@query("n27_nowcast_vs_actual", oracle(f"""SELECT CAST(g AS DATE) AS ts, n.value AS nowcast, t.value AS target FROM (SELECT min(f) AS lo FROM tf) CROSS JOIN (SELECT greatest((SELECT max(f) FROM tf), (SELECT max(ts) FROM nation_week WHERE series = 'NATION_5')) AS hi),
  generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY) q(g) LEFT JOIN (SELECT * FROM nation_week WHERE series = 'NATION_5') n ON n.ts = CAST(g AS DATE) LEFT JOIN tf t ON t.f = CAST(g AS DATE)""",
  "nation_week", "segment_month", ctes={"tf": f"SELECT {W_FRI.replace('isodow(d)', 'isodow(ts)').replace('d +', 'ts +')} AS f, value / 20 AS value FROM segment_month WHERE series = 'BUILDING'"}))
def n27(spark, sf):
    now, goal = _nowcast_inputs(spark, sf)
    return n.nowcast_vs_actual(now, goal)


@query("n28_looks_standardised", oracle("""SELECT round(avg(z), 6) + 0.0 AS mean, round(stddev_samp(z), 6) AS std, round(max(z) - min(z), 6) AS range, count(z) AS n,
  abs(avg(z)) < 0.5 AND stddev_samp(z) > 0.8 AND stddev_samp(z) < 1.2 AND max(z) - min(z) < 8 AND count(z) > 10 AS standardised
  FROM (SELECT (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM nation_week WHERE series = 'NATION_5')""", "nation_week"))
def n28(spark, sf):
    from tidepanel.operators.transforms import standardise

    z = standardise(b.nation_week(spark, sf).filter("series = 'NATION_5'")).select("ts", F.col("z").alias("value"))
    return rnd(n.looks_standardised(z)).withColumn("mean", F.col("mean") + F.lit(0.0))


@query("g15_status_counts")
def g15(spark, sf):
    _, log = pp.ensure_stationary(b.nation_week(spark, sf))
    return g.status_counts(log)


@query("g15_status_counts_by_rule", oracle("""SELECT CASE WHEN status LIKE 'skipped%' THEN 'skipped' ELSE 'checked' END AS stage, status, count(*) AS n_series FROM (
  SELECT series, CASE WHEN count(*) < 0.8 * max(count(*)) OVER () THEN 'skipped_short' WHEN stddev_samp(value) > avg(value) / 2 THEN 'log_diff' ELSE 'level' END AS status
  FROM brand_flag_week GROUP BY 1) GROUP BY 2""", "brand_flag_week"))
def g15r(spark, sf):
    s = b.brand_flag_week(spark, sf).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    most = s.agg(F.max("n")).scalar()
    status = F.when(F.col("n") < most * 0.8, "skipped_short").when(F.col("s") > F.col("m") / 2, "log_diff").otherwise("level")
    return g.status_counts(s.select("series", status.alias("status")))


# ---------------------------------------------------------------- one factor, fixed parameters
# With one factor and given parameters the filter is a recursion that SQL can
# follow: A = 0.6, Q = 1, x0 = 0, P0 = 1; a loading is the series' standard
# deviation and its noise half its variance.

_A = 0.6


def _fixed_loadings(obs):
    d = obs.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.var_samp("value").alias("v"))
    return d.select("series", F.array("std").alias("l"), (F.col("v") / 2).alias("r"), "mean", "std")


def _fixed_model(obs):
    m = fa.model_panel(obs)
    load = _fixed_loadings(obs).withColumn("panel", F.lit("all"))
    state = m.groupBy("panel").agg(F.max("n_t").alias("n_t")).select(
        "panel", "n_t", F.array(F.lit(_A)).alias("a"), F.array(F.lit(1.0)).alias("q"), F.array(F.lit(0.0)).alias("x0"), F.array(F.lit(1.0)).alias("p0"))
    model = {"panel": m, "loadings": load, "state": state}
    stamps = fa._stamps(m, "W-FRI")
    scan = fa.kalman_smoother(m, load, state, 1).filter("t >= 0").join(stamps, ["panel", "t"])
    model["filtered"] = scan.select("panel", "t", "ts", F.col("xf").alias("x"), F.col("xm").alias("x_minus"), "p")
    model["smoothed"] = scan.select("panel", "t", "ts", F.col("xs").alias("f"))
    return model


def _scan_sql(src, x=""):
    """CTEs of the forward and backward recursion over ``src(series, ts, value)``."""
    return {
        f"m{x}": f"SELECT series, ts, CAST((ts - (SELECT min(ts) FROM {src})) / 7 AS INTEGER) AS t, value - mean AS y, l, r FROM {src} JOIN par USING (series)",
        f"info{x}": f"SELECT t, sum(l * l / (r + 1e-4)) AS j, sum(l * y / (r + 1e-4)) AS h FROM m{x} GROUP BY 1",
        f"days{x}": f"SELECT CAST(q AS INTEGER) AS t, j, h, CAST((SELECT min(ts) FROM {src}) + CAST(q * 7 AS INTEGER) AS DATE) AS ts FROM generate_series(0, (SELECT max(t) FROM m{x})) g(q) LEFT JOIN info{x} i ON i.t = q",
        f"fwd{x}": f"""SELECT 0 AS t, 0.0::DOUBLE AS xm, 1.0::DOUBLE AS pm, 0.0::DOUBLE AS x, 1.0::DOUBLE AS p
          UNION ALL SELECT t, xm, pm, CASE WHEN j IS NULL THEN xm ELSE xm + pm / (1 + pm * j) * (h - j * xm) END, CASE WHEN j IS NULL THEN pm ELSE pm / (1 + pm * j) END
          FROM (SELECT d.t, {_A} * f.x AS xm, {_A * _A} * f.p + 1 + 1e-6 AS pm, d.j, d.h FROM fwd{x} f JOIN days{x} d ON d.t = f.t + 1)""",
        f"st{x}": f"SELECT f.*, d.ts FROM fwd{x} f JOIN days{x} d USING (t)",
        f"bwd{x}": f"""SELECT t, x AS xs FROM st{x} WHERE t = (SELECT max(t) FROM st{x})
          UNION ALL SELECT c.t, c.x + c.p * {_A} / n.pm * (b.xs - n.xm) FROM bwd{x} b JOIN st{x} n ON n.t = b.t JOIN st{x} c ON c.t = b.t - 1""",
    }


_PAR = {"par": "SELECT series, avg(value) AS mean, stddev_samp(value) AS l, var_samp(value) / 2 AS r FROM nation_week GROUP BY 1"}


def _recursive(body, *panels, ctes):
    return oracle(body, *panels, ctes=ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("n4_kalman_fixed_parameters", _recursive("""SELECT ts, round(x, 6) AS filtered, round(xm, 6) AS predicted, round(p, 6) AS variance, round(xs, 6) AS smoothed
  FROM st JOIN bwd USING (t)""", "nation_week", ctes={**_PAR, **_scan_sql("nation_week")}))
def n4_fixed(spark, sf):
    m = _fixed_model(_obs(spark, sf))
    one = lambda c: F.get(c, F.lit(0))
    d = m["filtered"].join(m["smoothed"].select("t", "f"), "t")
    return rnd(d.select("ts", one("x").alias("filtered"), one("x_minus").alias("predicted"), one("p").alias("variance"), one("f").alias("smoothed")))


@query("n12_month_end_fixed_parameters", _recursive(f"""SELECT st.ts, tt AS target_ts, CAST((tt - st.ts) // 7 AS INTEGER) AS h, round(l * pow({_A}, (tt - st.ts) // 7) * x + mean, 2) AS nowcast
  FROM (SELECT *, greatest(ts, CAST(last_day(ts) - CAST((isodow(last_day(ts)) + 2) % 7 AS INTEGER) AS DATE)) AS tt FROM st) st CROSS JOIN (SELECT * FROM par WHERE series = 'NATION_0')""",
  "nation_week", ctes={**_PAR, **_scan_sql("nation_week")}))
def n12_fixed(spark, sf):
    d = n.forecast_to_month_end(_fixed_model(_obs(spark, sf)), TARGET, 1)
    return rnd(d.select("ts", "target_ts", "h", "nowcast"), 2)


@query("n13_state_forecast_fixed_parameters", _recursive(f"""SELECT CAST(k AS INTEGER) AS h, CAST(ts + CAST(7 * k AS INTEGER) AS DATE) AS ts, round(pow({_A}, k) * x, 6) AS state,
  round(pow({_A}, 2 * k) * p + (1 - pow({_A}, 2 * k)) / (1 - {_A * _A}), 6) AS variance FROM (SELECT * FROM st ORDER BY t DESC LIMIT 1) CROSS JOIN generate_series(1, 8) g(k)""",
  "nation_week", ctes={**_PAR, **_scan_sql("nation_week")}))
def n13_fixed(spark, sf):
    d = n.state_forecast(_fixed_model(_obs(spark, sf)), 1, 8)
    return rnd(d.select("h", "ts", F.get("x", F.lit(0)).alias("state"), F.get("p", F.lit(0)).alias("variance")))


@query("n16_evolution_fixed_parameters", _recursive(f"""SELECT ts, CAST((tt - ts) // 7 AS INTEGER) AS horizon_weeks, round(l * pow({_A}, (tt - ts) // 7) * x, 2) AS nowcast_std
  FROM st CROSS JOIN (SELECT DATE '2001-10-26' AS tt) CROSS JOIN (SELECT l FROM par WHERE series = 'NATION_0') WHERE date_trunc('month', ts) = DATE '2001-10-01'""",
  "nation_week", ctes={**_PAR, **_scan_sql("nation_week")}))
def n16_fixed(spark, sf):
    d = n.nowcast_evolution(n.forecast_to_month_end(_fixed_model(_obs(spark, sf)), TARGET, 1), "2001-10")
    return rnd(d.select("ts", "horizon_weeks", "nowcast_std"), 2)


_CONTRIB = {**_PAR, **_scan_sql("nation_week"),
            "c": f"""SELECT m.ts, industry, lt * pow({_A}, (DATE '2001-10-26' - m.ts) // 7) * p * m.l / (m.r + 1e-4) * (y - m.l * xm) AS c FROM m JOIN st ON st.t = m.t
              JOIN nation_industry USING (series) CROSS JOIN (SELECT l AS lt FROM par WHERE series = 'NATION_0') WHERE date_trunc('month', m.ts) = DATE '2001-10-01'"""}


@query("n17_news_by_industry_fixed_parameters", _recursive("SELECT ts, " + ", ".join(
  f"round(coalesce(sum(c) FILTER (industry = '{i}' AND abs(c) > 1e-6), 0), 3) AS \"{i}\"" for i in ("AFRICA", "AMERICA", "ASIA", "MIDDLE EAST")) +
  ", round(coalesce(sum(c) FILTER (industry = 'EUROPE' AND abs(c) > 1e-6), 0), 3) AS \"其他未分类\" FROM c GROUP BY 1", "nation_week", "nation_industry", ctes=_CONTRIB))
def n17_fixed(spark, sf):
    names = ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"]  # one industry is not listed and counts under the default
    return rnd(n.news_by_industry(_fixed_model(_obs(spark, sf)), TARGET, 1.0, "2001-10", b.nation_industry(spark, sf), names, 1), 3)


_VINT = {**_PAR, "oldv": "SELECT series, ts, CASE WHEN ts = DATE '2001-09-21' THEN value * 0.9 ELSE value END AS value FROM nation_week WHERE ts <= DATE '2001-09-28'",
         **_scan_sql("nation_week"), **_scan_sql("oldv", "o"),
         "e": "SELECT t AS te, x AS xe FROM sto ORDER BY t DESC LIMIT 1",
         "it": f"""SELECT m.ts, m.t, m.series, m.y, m.l, m.r, coalesce(sto.xm, pow({_A}, m.t - te) * xe) AS xp FROM m LEFT JOIN mo ON mo.series = m.series AND mo.ts = m.ts
           LEFT JOIN sto ON sto.t = m.t CROSS JOIN e WHERE m.ts <= DATE '2001-11-09' AND m.y IS DISTINCT FROM mo.y"""}


@query("n15_news_fixed_parameters", _recursive(f"""SELECT it.ts, it.series, round(y + mean, 2) AS observed, round(it.l * xp + mean, 2) AS forecast, round(y - it.l * xp, 2) AS news,
  round(lt * pow({_A}, (DATE '2001-11-09' - it.ts) // 7) * p * it.l / (it.r + 1e-4), 6) AS weight,
  round(lt * pow({_A}, (DATE '2001-11-09' - it.ts) // 7) * p * it.l / (it.r + 1e-4) * (y - it.l * xp), 2) AS impact
  FROM it JOIN st ON st.t = it.t JOIN par ON par.series = it.series CROSS JOIN (SELECT l AS lt FROM par WHERE series = 'NATION_0')""", "nation_week", ctes=_VINT))
def n15_fixed(spark, sf):
    obs = _obs(spark, sf)
    new, old = _vintages(obs)
    m = _fixed_model(obs)
    now, before = n.apply_vintage(m, new, 1, interpolate=False), n.apply_vintage(m, old, 1, interpolate=False)
    return rnd(n.news(now, before, TARGET, "2001-11-09", 1), 2, weight=6)


@query("n14_vintages_fixed_parameters", _recursive("""SELECT 'now' AS panel, ts, round(x, 6) AS state, round(p, 6) AS variance FROM st
  UNION ALL SELECT 'before', ts, round(x, 6), round(p, 6) FROM sto""", "nation_week", ctes=_VINT))
def n14_fixed(spark, sf):
    obs = _obs(spark, sf)
    new, old = _vintages(obs)
    out = n.apply_vintage(_fixed_model(obs), new.unionByName(old), 1, interpolate=False)["filtered"]
    return rnd(out.select("panel", "ts", F.get("x", F.lit(0)).alias("state"), F.get("p", F.lit(0)).alias("variance")))


_OLD = "1985-01-04"  # 879 weeks before the impact date


@query("n15_news_old_revision", _recursive(f"""SELECT it.ts, it.series, round(y - it.l * xp, 2) AS news, round(lt * pow({_A}, (DATE '2001-11-09' - it.ts) // 7) * p * it.l / (it.r + 1e-4), 6) AS weight
  FROM it JOIN st ON st.t = it.t CROSS JOIN (SELECT l AS lt FROM par WHERE series = 'NATION_0')""", "nation_week", ctes={
    **_PAR, "newv": f"SELECT series, ts, value FROM nation_week UNION ALL SELECT 'NATION_3', DATE '{_OLD}', 1000.0",
    "oldv": f"""SELECT series, ts, CASE WHEN ts = DATE '2001-09-21' THEN value * 0.9 ELSE value END AS value FROM nation_week WHERE ts <= DATE '2001-09-28'
      UNION ALL SELECT 'NATION_3', DATE '{_OLD}', 900.0""",
    **_scan_sql("newv"), **_scan_sql("oldv", "o"), "e": _VINT["e"], "it": _VINT["it"]}))
def n15_old(spark, sf):
    """A revision far in the past still has its row."""
    extra = lambda v: spark.range(1).select(F.lit("NATION_3").alias("series"), F.lit(_OLD).cast("date").alias("ts"), F.lit(v).alias("value"))
    obs = _obs(spark, sf)
    new, old = (d.unionByName(extra(v).select(F.lit(x).alias("panel"), "series", "ts", "value")) for d, v, x in zip(_vintages(obs), (1000.0, 900.0), ("now", "before")))
    m = _fixed_model(obs)
    now, before = n.apply_vintage(m, new, 1, interpolate=False), n.apply_vintage(m, old, 1, interpolate=False)
    return rnd(n.news(now, before, TARGET, "2001-11-09", 1).select("ts", "series", "news", "weight"), 2, weight=6)


_MSTEP = {**_SC, "w2": "SELECT ts, max(score) FILTER (factor = 1) AS a, max(score) FILTER (factor = 2) AS c FROM sc GROUP BY 1 HAVING a IS NOT NULL AND c IS NOT NULL",
          "yy": "SELECT series, ts, value / 1000 - avg(value / 1000) OVER (PARTITION BY series) AS y, avg(value / 1000) OVER (PARTITION BY series) AS mean FROM nation_week",
          "ss": "SELECT series, count(*) AS n, sum(a * a) AS aa, sum(c * c) AS cc, sum(a * c) AS ac, sum(a * y) AS ay, sum(c * y) AS cy FROM yy JOIN w2 USING (ts) GROUP BY 1 HAVING count(*) > 2",
          "ll": "SELECT series, (ay * cc - cy * ac) / (aa * cc - ac * ac) AS l1, (cy * aa - ay * ac) / (aa * cc - ac * ac) AS l2 FROM ss"}


def _two_factor_loadings(spark, sf):
    data, f = _two(spark, sf)
    w = F.avg("value").over(p.Window.partitionBy("series"))
    m = data.withColumn("mean", w).withColumn("y", F.col("value") - F.col("mean"))
    return fa.solve_loadings(fa.factor_products(m, f, 2), 2), f


@query("n5_loadings_step", oracle("""SELECT series, round(l1, 6) AS l1, round(l2, 6) AS l2, round(greatest(var_pop(y - l1 * a - l2 * c), 1e-7), 4) AS r
  FROM yy JOIN w2 USING (ts) JOIN ll USING (series) GROUP BY series, l1, l2""", "nation_week", ctes=_MSTEP))
def n5_step(spark, sf):
    load, _ = _two_factor_loadings(spark, sf)
    return rnd(load.select("series", F.get("l", F.lit(0)).alias("l1"), F.get("l", F.lit(1)).alias("l2"), "r"), r=4)


@query("n6_reconstruct_two_factors", oracle("""SELECT series, w2.ts, round(l1 * a + l2 * c + mean, 4) AS value FROM ll CROSS JOIN w2 JOIN (SELECT DISTINCT series, mean FROM yy) USING (series)""", "nation_week", ctes=_MSTEP))
def n6_two(spark, sf):
    load, f = _two_factor_loadings(spark, sf)
    day = F.date_add(F.lit("1970-01-09").cast("date"), F.col("t") * 7)  # Friday of week t
    return rnd(fa.reconstruct(f.withColumn("ts", day), load).select("series", "ts", "value"), 4)

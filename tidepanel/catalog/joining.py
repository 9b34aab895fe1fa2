"""Join, comparison and patching queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import oracle, query, rnd, table
from tidepanel.operators import joins as j
from tidepanel.operators import panel as p


def _obs(spark, sf):
    """Three versions of the brand panel: the base, one with holes and dropped
    rows, one with edited values."""
    d = b.brand_week(spark, sf)
    s, v = F.col("series"), F.col("value")
    base = d.select(F.lit("base").alias("dataset"), "series", "ts", "value")
    holes = d.filter(~(s.endswith("7") & (F.col("ts") < F.lit("1996-01-01").cast("date"))))
    holes = holes.select(F.lit("holes").alias("dataset"), "series", "ts", F.when(~(s.endswith("3") & (v > 220)), v).alias("value"))
    edit = d.filter(s != "Brand#25").select(F.lit("edit").alias("dataset"), "series", "ts", F.when(s.endswith("5") & (v > 200), v + 1).otherwise(v).alias("value"))
    return base.unionByName(holes).unionByName(edit)


_OBS = {"obs": """SELECT 'base' AS dataset, series, ts, value FROM brand_week
  UNION ALL SELECT 'holes', series, ts, CASE WHEN NOT (series LIKE '%3' AND value > 220) THEN value END FROM brand_week WHERE NOT (series LIKE '%7' AND ts < DATE '1996-01-01')
  UNION ALL SELECT 'edit', series, ts, CASE WHEN series LIKE '%5' AND value > 200 THEN value + 1 ELSE value END FROM brand_week WHERE series <> 'Brand#25'"""}


@query("j1_merge_inner", """SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey""")
def j1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return j.merge(o, c, "inner", left_on=["o_custkey"], right_on=["c_custkey"]).drop("c_custkey")


def _two_sides(spark, sf):
    """Weekly and monthly totals of every brand: keys (series, ts) on both sides, on one, and equal column names."""
    return b.brand_week(spark, sf), b.brand_month(spark, sf)


_ON = "ON l.series = r.series AND l.ts = r.ts"


@query("j1_merge_outer_suffixes", oracle(f"""SELECT coalesce(l.series, r.series) AS series, coalesce(l.ts, r.ts) AS ts, l.value AS value_x, r.value AS value_y
  FROM brand_week l FULL JOIN brand_month r {_ON}""", "brand_week", "brand_month"))
def j1o(spark, sf):
    return j.merge(*_two_sides(spark, sf), "outer", on=["series", "ts"])


@query("j1_merge_left", oracle(f"SELECT l.series, l.ts, l.value AS value_x, r.value AS value_y FROM brand_week l LEFT JOIN brand_month r {_ON}", "brand_week", "brand_month"))
def j1l(spark, sf):
    return j.merge(*_two_sides(spark, sf), "left", on=["series", "ts"])


@query("j1_merge_right", oracle(f"SELECT r.series, r.ts, l.value AS value_a, r.value AS value_b FROM brand_week l RIGHT JOIN brand_month r {_ON}", "brand_week", "brand_month"))
def j1r(spark, sf):
    return j.merge(*_two_sides(spark, sf), "right", on=["series", "ts"], suffixes=("_a", "_b"))


@query("j1_merge_index", oracle(f"""SELECT coalesce(l.ts, r.ts) AS ts, l.series AS series, r.series AS name, l.value AS value_x, r.value AS value_y
  FROM brand_week l FULL JOIN brand_month r {_ON}""", "brand_week", "brand_month"))
def j1x(spark, sf):
    """A merge on the index is a merge on its columns under their names on each side."""
    left, right = _two_sides(spark, sf)
    out = j.merge(left, right.withColumnsRenamed({"ts": "day", "series": "name"}), "outer", left_on=["series", "ts"], right_on=["name", "day"])
    return out.withColumn("ts", F.coalesce("ts", "day")).drop("day")


@query("j1_merge_cross", """SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation CROSS JOIN region""")
def j1c(spark, sf):
    return j.merge(table(spark, sf, "nation"), table(spark, sf, "region"), "cross")


@query("j2_merge_as_daily", oracle("""SELECT side, series, ts, round(value, 6) AS value FROM (
  SELECT 'left' AS side, series, ts, value FROM (""" + b.dense_sql("nation_week", "D") + """) UNION ALL SELECT 'right', series, ts, value FROM (""" + b.dense_sql("flag_day", "D") + """))
  WHERE ts >= (SELECT max(m) FROM (SELECT min(ts) AS m FROM nation_week UNION ALL SELECT min(ts) FROM flag_day))
    AND ts <= (SELECT min(m) FROM (SELECT max(ts) AS m FROM nation_week UNION ALL SELECT max(ts) FROM flag_day))""", "nation_week", "flag_day"))
def j2(spark, sf):
    out, _ = j.merge_as_daily(b.nation_week(spark, sf), b.flag_day(spark, sf), "inner")
    return rnd(out)


@query("j2_merged_frequency", oracle("SELECT 'merged' AS series, 'D' AS frequency FROM flag_day GROUP BY 1", "flag_day"))
def j2f(spark, sf):
    return j.merge_as_daily(b.nation_week(spark, sf), b.flag_day(spark, sf), "inner")[1]


_J2K = {"l0": "SELECT CAST(o_orderdate AS DATE) AS ts, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
        "r0": "SELECT CAST(l_shipdate AS DATE) AS ts, CAST(count(*) // 4 AS DOUBLE) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1",
        **{x: f"""SELECT CAST(c.g AS DATE) AS ts, n, total FROM (SELECT min(ts) AS lo, max(ts) AS hi FROM {x}0), generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY) c(g)
  LEFT JOIN {x}0 d ON d.ts = CAST(c.g AS DATE)""" for x in "lr"}}


def _order_and_ship_days(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    left = o.groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("n"), b.exact_sum("o_totalprice").alias("total"))
    right = li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(F.floor(F.count(F.lit(1)) / 4).cast("double").alias("n"), b.exact_sum("l_quantity").alias("total"))
    return left, right


@query("j2_merge_on_keys", oracle("""SELECT l.ts, l.n, l.total AS total_x, r.ts AS ts_y, r.total AS total_y FROM l
  LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY n ORDER BY ts) = 1) r ON l.n IS NOT DISTINCT FROM r.n""", ctes=_J2K))
def j2k(spark, sf):
    """Days of orders meet the first day with as many shipments."""
    return j.merge_as_daily_on(*_order_and_ship_days(spark, sf), ["n"], "left")[0]


@query("j2_merge_on_time_and_keys", oracle("""SELECT coalesce(l.ts, r.ts) AS ts, coalesce(l.n, r.n) AS n, l.total AS total_x, r.total AS total_y
  FROM l FULL JOIN r ON l.ts = r.ts AND l.n IS NOT DISTINCT FROM r.n
  QUALIFY row_number() OVER (PARTITION BY coalesce(l.ts, r.ts) ORDER BY coalesce(l.n, r.n) NULLS FIRST) = 1""", ctes=_J2K))
def j2t(spark, sf):
    return j.merge_as_daily_on(*_order_and_ship_days(spark, sf), ["ts", "n"], "outer")[0]


@query("j3_outer_time_join", oracle("""SELECT coalesce(l.ts, r.ts) AS ts, l.value AS value_left, r.series AS series_right, r.value AS value_right
  FROM (SELECT ts, sum(value) AS value FROM flag_day GROUP BY 1) l FULL JOIN nation_week r ON l.ts = r.ts""", "flag_day", "nation_week"))
def j3(spark, sf):
    day = b.flag_day(spark, sf).groupBy("ts").agg(F.sum("value").alias("value"))
    return j.outer_time_join(day, b.nation_week(spark, sf).select("series", "ts", "value"))


@query("j4_concat_panels", oracle("""SELECT series, ts, value FROM flag_day UNION ALL SELECT series, ts, value FROM brand_week
  UNION ALL SELECT series, ts, value FROM nation_week""", "flag_day", "brand_week", "brand_month", "nation_week"))
def j4(spark, sf):
    """The first panel that has a series gives all of it: the monthly brands lose to the weekly ones."""
    return j.concat_panels([b.flag_day(spark, sf), b.brand_week(spark, sf), j.append(b.brand_month(spark, sf), b.nation_week(spark, sf))])


@query("j5_append", oracle("SELECT series, ts, value FROM brand_week UNION ALL SELECT series, ts, value FROM nation_week", "brand_week", "nation_week"))
def j5(spark, sf):
    return j.append(b.brand_week(spark, sf), b.nation_week(spark, sf))


@query("j6_common_series", oracle("SELECT series FROM obs GROUP BY 1 HAVING count(DISTINCT dataset) = 3", "brand_week", ctes=_OBS))
def j6(spark, sf):
    return j.common_series(_obs(spark, sf))


@query("j7_index_difference", oracle("""SELECT coalesce(a.ts, z.ts) AS ts, CASE WHEN z.ts IS NULL THEN 'only_a' ELSE 'only_b' END AS status
  FROM (SELECT DISTINCT ts FROM flag_day) a FULL JOIN (SELECT DISTINCT ts FROM nation_week) z ON a.ts = z.ts WHERE a.ts IS NULL OR z.ts IS NULL""", "flag_day", "nation_week"))
def j7(spark, sf):
    return j.index_difference(b.flag_day(spark, sf), b.nation_week(spark, sf))[0]


@query("j7_index_lengths", oracle("""SELECT count(a.ts) AS length_a, count(z.ts) AS length_b, count(*) FILTER (z.ts IS NULL) AS only_a, count(*) FILTER (a.ts IS NULL) AS only_b
  FROM (SELECT DISTINCT ts FROM flag_day) a FULL JOIN (SELECT DISTINCT ts FROM nation_week) z ON a.ts = z.ts""", "flag_day", "nation_week"))
def j7l(spark, sf):
    return j.index_difference(b.flag_day(spark, sf), b.nation_week(spark, sf))[1]


@query("j8_compare_series", oracle("""SELECT o.series, coalesce(z.ts, o.ts) AS ts, z.value AS base, o.value AS other, z.value - o.value AS difference FROM
  (SELECT n.series, c.ts, v.value FROM (SELECT DISTINCT series FROM nation_week WHERE series <> 'NATION_0') n CROSS JOIN (SELECT DISTINCT ts FROM nation_week) c LEFT JOIN nation_week v ON v.series = n.series AND v.ts = c.ts) o
  LEFT JOIN (SELECT * FROM nation_week WHERE series = 'NATION_0') z ON z.ts = o.ts WHERE z.value IS DISTINCT FROM o.value""", "nation_week"))
def j8(spark, sf):
    return j.compare_series(b.nation_week(spark, sf), "NATION_0")[1]


_CMP = {**_OBS, "com": "SELECT series FROM obs GROUP BY 1 HAVING count(DISTINCT dataset) = 3",
        "ln": "SELECT series, min(n) <> max(n) AS ldiff FROM (SELECT series, dataset, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1",
        "pr": """SELECT series, ts, d AS dataset, r.value AS ref, o.value FROM (SELECT 'holes' AS d UNION ALL SELECT 'edit') CROSS JOIN (SELECT DISTINCT series, ts FROM obs WHERE value IS NOT NULL) k
          LEFT JOIN (SELECT * FROM obs WHERE dataset = 'base' AND value IS NOT NULL) r USING (series, ts) LEFT JOIN (SELECT * FROM obs WHERE value IS NOT NULL) o ON o.series = k.series AND o.ts = k.ts AND o.dataset = d""".replace("SELECT series, ts, d", "SELECT k.series, k.ts, d"),
        "per": """SELECT series, dataset, CASE dataset WHEN 'holes' THEN 2 ELSE 3 END AS r, count(ref) <> count(value) AS ld, count(*) FILTER (ref IS DISTINCT FROM value) AS nd FROM pr GROUP BY 1, 2""",
        "fi": "SELECT series, arg_min(dataset, r) AS dataset, arg_min(ld, r) AS ld, arg_min(nd, r) AS nd FROM per WHERE ld OR nd > 0 GROUP BY 1",
        "st": """SELECT com.series, CASE WHEN ldiff THEN 'original_length_mismatch' WHEN ld THEN 'length_mismatch' WHEN ld IS NOT NULL THEN 'different_values' ELSE 'identical' END AS status, dataset, nd
          FROM com JOIN ln USING (series) LEFT JOIN fi USING (series)"""}


@query("j9_compare_datasets", oracle("""SELECT series, status, CASE WHEN status IN ('length_mismatch', 'different_values') THEN dataset END AS dataset,
  CASE WHEN status = 'different_values' THEN nd ELSE 0 END AS n_different FROM st""", "brand_week", ctes=_CMP))
def j9(spark, sf):
    return j.compare_datasets(_obs(spark, sf), ["base", "holes", "edit"])[0]


@query("j9_differing_rows", oracle("""SELECT pr.series, pr.dataset, ts, ref, value FROM pr JOIN st ON pr.series = st.series AND pr.dataset = st.dataset
  WHERE ref IS DISTINCT FROM value AND status IN ('length_mismatch', 'different_values')""", "brand_week", ctes=_CMP))
def j9r(spark, sf):
    return j.compare_datasets(_obs(spark, sf), ["base", "holes", "edit"])[1]


@query("j10_same_values_other_name", oracle("""SELECT first, series, CAST(count(*) OVER (PARTITION BY first) AS BIGINT) AS group_size FROM (SELECT series, min(series) OVER (PARTITION BY sig) AS first, count(*) OVER (PARTITION BY sig) AS k
  FROM (SELECT series, string_agg(ts || ':' || coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY ts) AS sig FROM
   (SELECT dataset || ':' || series AS series, ts, value FROM obs) GROUP BY 1)) WHERE k > 1""", "brand_week", ctes=_OBS))
def j10(spark, sf):
    d = _obs(spark, sf).select(F.concat_ws(":", "dataset", "series").alias("series"), "ts", "value")
    return j.same_values_other_name(d)


def _patch_sql(cond, log=False):
    cols = ("t.series, t.ts, t.value AS old_value, s.value AS new_value" if log else
            f"t.series, t.ts, CASE WHEN {cond} THEN s.value ELSE t.value END AS value")
    where = f" WHERE ({cond}) AND t.value IS DISTINCT FROM s.value" if log else ""
    return oracle(f"""SELECT {cols} FROM (SELECT * FROM obs WHERE dataset = 'holes') t LEFT JOIN (SELECT * FROM obs WHERE dataset = 'edit' AND value IS NOT NULL) s
      ON t.series = s.series AND t.ts = s.ts{where}""", "brand_week", ctes=_OBS)


def _sides(spark, sf):
    o = _obs(spark, sf)
    return o.filter("dataset = 'holes'").drop("dataset"), o.filter("dataset = 'edit'").drop("dataset")


@query("j11_patch_fill_missing", _patch_sql("t.value IS NULL AND s.value IS NOT NULL"))
def j11(spark, sf):
    return j.patch_series(*_sides(spark, sf), "fill_missing")[0]


@query("j11_patch_replace_all_log", _patch_sql("s.value IS NOT NULL", log=True))
def j11a(spark, sf):
    return j.patch_series(*_sides(spark, sf), "replace_all")[1]


@query("j11_patch_dates_log", _patch_sql("s.value IS NOT NULL AND t.ts IN (DATE '1998-01-02', DATE '1999-01-01', DATE '2000-06-30')", log=True))
def j11d(spark, sf):
    return j.patch_series(*_sides(spark, sf), "replace_specific_dates", ["1998-01-02", "1999-01-01", "2000-06-30"])[1]


@query("j12_asof_value", oracle("""SELECT q.series, q.ts, max(p.ts) AS value_ts, arg_max(p.value, p.ts) AS value FROM (SELECT DISTINCT series, last_day(ts) AS ts FROM brand_week) q
  LEFT JOIN brand_week p ON p.series = q.series AND p.ts <= q.ts GROUP BY 1, 2""", "brand_week"))
def j12(spark, sf):
    d = b.brand_week(spark, sf)
    return j.asof_value(d, d.select("series", F.last_day("ts").alias("ts")).distinct())


@query("j13_dimension_lookup", oracle("""SELECT coalesce(industry, '未分类') AS industry, count(*) AS n, round(sum(value), 2) AS total FROM nation_week
  LEFT JOIN (SELECT * FROM nation_industry WHERE industry <> 'ASIA') USING (series) GROUP BY 1""", "nation_week", "nation_industry"))
def j13(spark, sf):
    dim = b.nation_industry(spark, sf).filter("industry <> 'ASIA'")
    d = j.lookup(b.nation_week(spark, sf), dim)
    return rnd(d.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


@query("j14_weekly_with_monthly_target", oracle("""SELECT CAST(date_trunc('month', n.ts) AS DATE) AS month, n.ts, n.value AS nowcast, target, previous_target FROM (SELECT * FROM nation_week WHERE series = 'NATION_5') n
  JOIN (SELECT m, target, lag(target) OVER (ORDER BY m) AS previous_target FROM (SELECT date_trunc('month', ts) AS m, arg_min(value, ts) AS target FROM segment_month WHERE series = 'BUILDING' GROUP BY 1)) t
  ON t.m = date_trunc('month', n.ts)""", "nation_week", "segment_month"))
def j14(spark, sf):
    n = b.nation_week(spark, sf).filter("series = 'NATION_5'")
    return j.weekly_with_monthly_target(n, b.segment_month(spark, sf).filter("series = 'BUILDING'"))


@query("j15_coverage_report", """WITH w AS (SELECT DISTINCT lower(p_brand) AS key FROM part WHERE p_brand <> 'Brand#4' UNION SELECT 'brand#99'), l AS (SELECT DISTINCT lower(p_brand) AS key FROM part),
  f AS (SELECT DISTINCT lower(p_brand) AS key FROM part WHERE p_brand NOT LIKE '%3'), lg AS (SELECT DISTINCT lower(p_brand) AS key, 'dropped' AS reason FROM part WHERE p_brand LIKE '%13')
  SELECT key AS name, status, CASE WHEN status = 'removed' THEN coalesce(reason, 'unknown') END AS reason FROM (SELECT key, CASE WHEN w.key IS NOT NULL AND l.key IS NULL THEN 'missing_in_data'
   WHEN w.key IS NULL AND l.key IS NOT NULL THEN 'extra_in_data' WHEN w.key IS NOT NULL AND f.key IS NULL THEN 'removed' ELSE 'ok' END AS status FROM w FULL JOIN l USING (key) LEFT JOIN f USING (key)) LEFT JOIN lg USING (key)""")
def j15(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    extra = brands.filter("name = 'Brand#1'").select(F.lit("Brand#99").alias("name"))
    log = brands.filter("name like '%13'").withColumn("reason", F.lit("dropped"))
    return j.coverage_report(brands.filter("name <> 'Brand#4'").unionByName(extra), brands.withColumn("name", F.concat(F.lit(" "), F.upper("name"))),
                             brands.filter("name not like '%3'"), log)


@query("j16_indicators_by_industry", oracle("""SELECT industry, series FROM nation_industry
  WHERE series IN (SELECT series FROM nation_week)""", "nation_industry", "nation_week"))
def j16(spark, sf):
    return j.indicators_by_industry(b.nation_industry(spark, sf), b.nation_week(spark, sf))

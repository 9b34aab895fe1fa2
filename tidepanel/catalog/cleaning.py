"""Name, cleaning, time-parsing and missing-data queries."""

from pyspark.sql import functions as F

from tidepanel.catalog import base as b
from tidepanel.catalog.base import oracle, query, r, rnd, table
from tidepanel.functions.names import match_key, normalize_name, normalize_punct
from tidepanel.operators import clean as c
from tidepanel.operators import panel as p

_NORM = r"regexp_replace(regexp_replace(translate(text, '（）：　', '(): '), ':\s*', ': ', 'g'), '\s+', ' ', 'g')"


@query("c1_normalize_name", f"SELECT doc_id, length(trim({_NORM})) AS n, md5(trim({_NORM})) AS h FROM documents")
def c1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", normalize_name(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


_PUNCT = r"regexp_replace(translate(text, '：（），。；！？', ':(),.;!?'), '\s+', ' ', 'g')"


@query("c2_normalize_punct", f"SELECT doc_id, md5(trim({_PUNCT})) AS h FROM documents")
def c2(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(normalize_punct(F.col("text"))).alias("h"))


def _part_names(spark, sf):
    """Requested: full part names with stray case and blanks; actual: names and types."""
    pt = table(spark, sf, "part")
    req = pt.select(F.concat(F.lit(" "), F.initcap("p_name")).alias("name")).distinct()
    req = req.unionByName(pt.select(F.concat("p_type", F.lit(" INDEX")).alias("name")).distinct())
    req = req.unionByName(pt.select("p_brand").distinct().withColumnRenamed("p_brand", "name"))
    act = pt.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    act = act.unionByName(pt.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("ord")))
    act = act.unionByName(pt.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ord")))
    return req, act


@query("c3_match_names", """WITH req AS (SELECT DISTINCT ' ' || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' '
      || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS name FROM part
    UNION ALL SELECT DISTINCT p_type || ' INDEX' FROM part UNION ALL SELECT DISTINCT p_brand FROM part),
  act AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part GROUP BY 1 UNION ALL SELECT p_type, min(p_partkey) FROM part GROUP BY 1
    UNION ALL SELECT p_brand, min(p_partkey) FROM part GROUP BY 1),
  hit AS (SELECT r.name AS requested, a.name AS actual, ord, CASE WHEN r.name = a.name THEN 1
      WHEN lower(trim(r.name)) = lower(trim(a.name)) THEN 2 ELSE 6 END AS rank
    FROM req r JOIN act a ON r.name = a.name OR contains(lower(trim(r.name)), lower(trim(a.name))) OR contains(lower(trim(a.name)), lower(trim(r.name))))
  SELECT requested, actual, rank FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY rank, ord, actual) AS rn FROM hit) WHERE rn = 1""")
def c3(spark, sf):
    req, act = _part_names(spark, sf)
    return c.match_names(req, act)


@query("c4_select_time_filter", oracle("""SELECT series, ts, value FROM brand_day
  WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""", "brand_day"))
def c4(spark, sf):
    return c.time_filter(b.brand_day(spark, sf), "1997-03-01", "1998-02-28").select("series", "ts", "value")


@query("c5_rename", oracle("""SELECT CASE series WHEN 'NATION_0' THEN 'Nation Zero' WHEN 'NATION_7' THEN 'Nation Seven' ELSE series END AS series,
  count(*) AS n, max(ts) AS last_ts FROM nation_week GROUP BY 1""", "nation_week"))
def c5(spark, sf):
    names = [f"NATION_{i}" for i in range(25)]
    d = c.rename_series(b.nation_week(spark, sf), {"NATION_0": "Nation Zero", "NATION_7": "Nation Seven"}, names)
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query("c6_rename_by_text", oracle("""SELECT replace(series, 'Brand#', 'B') AS series, sum(value) AS value FROM brand_week GROUP BY 1""", "brand_week"))
def c6(spark, sf):
    d = c.rename_by_text(b.brand_week(spark, sf), "Brand#", "B")
    return d.groupBy("series").agg(F.sum("value").alias("value"))


@query("c6_rename_collisions", oracle("""SELECT replace(series, '/A', '') AS new_name, count(*) AS n_names
  FROM (SELECT DISTINCT CASE WHEN series LIKE '%/N' THEN left(series, length(series) - 2) ELSE series END AS series FROM brand_flag_week)
  GROUP BY 1 HAVING count(*) > 1""", "brand_flag_week"))
def c6c(spark, sf):
    s = F.col("series")
    names = b.brand_flag_week(spark, sf).withColumn("series", F.when(s.endswith("/N"), F.substring_index(s, "/", 1)).otherwise(s))
    return c.rename_collisions(names, "/A", "")


def _headers(spark, sf):
    """Header names with ``.N`` suffixes: part name and size, plain for size 1."""
    pt = table(spark, sf, "part")
    return pt.select(F.when(F.col("p_size") == 1, F.col("p_name"))
                     .otherwise(F.concat("p_name", F.lit("."), F.col("p_size").cast("string"))).alias("name")).distinct()


_HEAD = {"h": "SELECT DISTINCT CASE WHEN p_size = 1 THEN p_name ELSE p_name || '.' || p_size END AS name FROM part",
         "hp": r"""SELECT name, CASE WHEN regexp_full_match(name, '(.+)\.(\d+)') THEN regexp_extract(name, '^(.+)\.(\d+)$', 1) ELSE name END AS base,
           CASE WHEN regexp_full_match(name, '(.+)\.(\d+)') THEN CAST(regexp_extract(name, '^(.+)\.(\d+)$', 2) AS BIGINT) ELSE -1 END AS suffix FROM h"""}


@query("c7_duplicate_names", oracle("""SELECT base, n_names, name FROM (SELECT lower(trim(base)) AS base, name,
  count(*) OVER (PARTITION BY lower(trim(base))) AS n_names FROM hp) WHERE n_names > 1""", ctes=_HEAD))
def c7(spark, sf):
    return c.duplicate_names(_headers(spark, sf))


@query("c8_drop_duplicate_columns", oracle("""SELECT name, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY suffix) = 1 THEN 'kept' ELSE 'removed' END AS status
  FROM hp""", ctes=_HEAD))
def c8(spark, sf):
    kept, removed = c.drop_duplicate_columns(_headers(spark, sf))
    return kept.withColumn("status", F.lit("kept")).unionByName(removed.withColumn("status", F.lit("removed")))


@query("c9_dedupe_column_names", oracle("""SELECT name, CASE WHEN count(*) OVER (PARTITION BY base) > 1 OR suffix >= 0
  THEN base || '_v' || row_number() OVER (PARTITION BY base ORDER BY suffix) ELSE name END AS new_name FROM hp""", ctes=_HEAD))
def c9(spark, sf):
    return c.dedupe_column_names(_headers(spark, sf))


@query("c10_custom_missing", """SELECT l_returnflag, count(l_quantity) AS n_quantity, count(CASE WHEN l_linestatus <> 'F' THEN 1 END) AS n_status
  FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity NOT IN (1, 50) THEN l_quantity END AS l_quantity FROM lineitem) GROUP BY 1""")
def c10(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_linestatus")
    d = c.custom_missing(li, [1, 50, "F"], ["l_quantity", "l_linestatus"])
    return d.groupBy("l_returnflag").agg(F.count("l_quantity").alias("n_quantity"), F.count("l_linestatus").alias("n_status"))


@query("c11_zero_to_missing", """SELECT l_returnflag, count(CASE WHEN abs(l_discount) >= 1e-9 THEN 1 END) AS n,
  round(avg(CASE WHEN abs(l_discount) >= 1e-9 THEN l_discount END), 6) AS mean_discount FROM lineitem GROUP BY 1""")
def c11(spark, sf):
    li = c.zero_to_missing(table(spark, sf, "lineitem").select("l_returnflag", "l_discount"), "l_discount")
    return rnd(li.groupBy("l_returnflag").agg(F.count("l_discount").alias("n"), F.avg("l_discount").alias("mean_discount")))


@query("c12_clean_numeric_text", """SELECT c_mktsegment, count(*) AS n, round(sum(CAST(c_acctbal AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM customer GROUP BY 1""")
def c12(spark, sf):
    cu = table(spark, sf, "customer")
    text = F.concat(F.format_number("c_acctbal", 2), F.lit("%"))
    d = cu.select("c_mktsegment", c.clean_numeric_text(text).alias("v"))
    return d.groupBy("c_mktsegment").agg(F.count("v").alias("n"), b.exact_sum("v").alias("total"))


@query("c13_parse_time", """SELECT l_orderkey, l_linenumber, 'yyyy年M月d日' AS time_format, CAST(l_shipdate AS TIMESTAMP) AS ship FROM lineitem""")
def c13(spark, sf):
    li = table(spark, sf, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy年M月d日").alias("ship"))
    return c.parse_time(d, "ship")


@query("c13_parse_excel_serial", """SELECT o_orderkey, 'excel_serial' AS time_format, CAST(o_orderdate AS TIMESTAMP) AS serial FROM orders""")
def c13s(spark, sf):
    o = table(spark, sf, "orders")
    return c.parse_time(o.select("o_orderkey", F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).alias("serial")), "serial")


@query("c14_identify_time_column", """SELECT 'order_date' AS time_column, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_ts, CAST(max(o_orderdate) AS DATE) AS last_ts FROM orders""")
def c14(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("stamp"),
                                          F.date_format("o_orderdate", "yyyy/M/d").alias("order_date"))
    col = c.identify_time_column(o)
    d = c.parse_time(o, col)
    return d.agg(F.lit(col).alias("time_column"), F.count(col).alias("n"), F.to_date(F.min(col)).alias("first_ts"), F.to_date(F.max(col)).alias("last_ts"))


@query("c15_auto_datetime", """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS order_date, o_orderpriority FROM orders""")
def c15(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("order_date"), "o_orderpriority")
    return c.auto_datetime(o)


@query("c16_dedupe_rows_by_time", oracle("""SELECT series, ts, arg_max(value, seq) AS last_value, arg_min(value, seq) AS first_value
  FROM event_raw GROUP BY 1, 2""", "event_raw"))
def c16(spark, sf):
    raw = b.event_raw(spark, sf)
    last = p.contract(raw, seq="seq").withColumnRenamed("value", "last_value")
    first = p.contract(raw, seq="seq", keep="first").withColumnRenamed("value", "first_value")
    return last.join(first, ["series", "ts"])


@query("c17_month_sheet_shift", oracle("""SELECT left(series, 1) AS sheet, series, CASE WHEN left(series, 1) IN
  (SELECT left(series, 1) FROM segment_month WHERE contains(series, 'MACH')) THEN last_day(ts - INTERVAL 1 MONTH) ELSE ts END AS ts, value
  FROM segment_month""", "segment_month"))
def c17(spark, sf):
    d = b.segment_month(spark, sf).withColumn("sheet", F.substring("series", 1, 1))
    return c.shift_month_sheets(d, "MACH")


@query("c18_drop_all_null", oracle("""SELECT series, count(value) AS n FROM
  (SELECT series, CASE WHEN value > 1.5 * (SELECT avg(value) FROM brand_flag_week) AND series LIKE '%/R' OR series LIKE '%/A' THEN value END AS value
   FROM brand_flag_week) GROUP BY 1 HAVING count(value) > 0""", "brand_flag_week"))
def c18(spark, sf):
    d = b.brand_flag_week(spark, sf)
    s, mean = F.col("series"), d.agg(F.avg("value")).scalar()
    d = d.withColumn("value", F.when(((F.col("value") > mean * 1.5) & s.endswith("/R")) | s.endswith("/A"), F.col("value")))
    kept, _ = c.drop_all_null_series(d)
    return kept.groupBy("series").agg(F.count("value").alias("n"))


_ISL = {"isl": "SELECT series, ts, value, count(value) OVER (PARTITION BY series ORDER BY ts) AS blk FROM dense",
        "runs": "SELECT series, blk, count(*) AS n, count(value) AS nn, min(CASE WHEN value IS NOT NULL THEN ts END) AS f FROM isl GROUP BY 1, 2",
        "prof": """SELECT series, 100.0 * sum(n - nn) / sum(n) AS missing_pct,
          100.0 * sum(n - nn) FILTER (blk > 0) / nullif(sum(n) FILTER (blk > 0), 0) AS missing_after_first_pct, min(f) AS first_valid,
          CAST(sum(nn) AS BIGINT) AS n_values, max(n - nn) AS longest_run, coalesce(max(n - nn) FILTER (blk > 0), 0) AS longest_run_after_first
          FROM runs GROUP BY 1"""}


@query("c19_drop_long_gaps", oracle("""SELECT series, 'daily_consecutive_nan' AS reason, longest_run_after_first AS longest_run
  FROM prof WHERE longest_run_after_first >= 8""", "brand_day", dense=("brand_day", "D"), ctes=_ISL))
def c19(spark, sf):
    _, log = c.drop_long_gaps(p.densify(b.brand_day(spark, sf), "D"), 8, "daily")
    return log


#: Daily series with a hole of eight days or more between two values, found from the raw rows.
_HOLES = {"holed": """SELECT DISTINCT series FROM (SELECT series, lead(ts) OVER (PARTITION BY series ORDER BY ts) - ts AS step FROM brand_day WHERE value IS NOT NULL) WHERE step > 8
  UNION SELECT series FROM brand_day WHERE value IS NOT NULL GROUP BY 1 HAVING (SELECT max(ts) FROM brand_day) - max(ts) >= 8"""}


@query("c19_kept_after_gaps", oracle("""SELECT d.series, CAST(d.ts AS DATE) AS ts, v.value FROM (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts
    FROM (SELECT DISTINCT series FROM brand_day) CROSS JOIN (SELECT min(ts) AS lo, max(ts) AS hi FROM brand_day) WHERE series NOT IN (SELECT series FROM holed)) d
  LEFT JOIN brand_day v ON v.series = d.series AND v.ts = d.ts""", "brand_day", ctes=_HOLES))
def c19k(spark, sf):
    kept, _ = c.drop_long_gaps(p.densify(b.brand_day(spark, sf), "D"), 8, "daily")
    return kept


@query("c20_train_window", oracle("""SELECT series, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM nation_week
  WHERE ts BETWEEN DATE '1996-01-05' AND DATE '1999-12-31' GROUP BY 1""", "nation_week"))
def c20(spark, sf):
    d = c.time_filter(b.nation_week(spark, sf), "1996-01-05", "1999-12-31")
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("k_match_key", "SELECT DISTINCT lower(trim(p_name)) AS key FROM part")
def k_key(spark, sf):
    """Names are compared after NFKC, trim and lower; the UDF sees distinct names only."""
    names = table(spark, sf, "part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("name")).distinct()
    return names.select(match_key(F.col("name")).alias("key")).distinct()


# ---------------------------------------------------------------- missing data

def _dense_day(spark, sf):
    return p.densify(b.brand_day(spark, sf), "D")


def _dense_flag(spark, sf):
    return p.densify(b.brand_flag_week(spark, sf), "W-FRI")


@query("m1_missing_profile", oracle("""SELECT series, round(missing_pct, 6) AS missing_pct, round(missing_after_first_pct, 6) AS missing_after_first_pct,
  first_valid, n_values, longest_run, longest_run_after_first FROM prof""", "brand_day", dense=("brand_day", "D"), ctes=_ISL))
def m1(spark, sf):
    return rnd(c.missing_profile(_dense_day(spark, sf)))


@query("m2_longest_run", oracle("SELECT series, longest_run FROM prof", "brand_flag_week", dense=("brand_flag_week", "W"), ctes=_ISL))
def m2(spark, sf):
    return c.longest_missing_run(_dense_flag(spark, sf))


_W = "(PARTITION BY series ORDER BY ts ROWS BETWEEN"


@query("m3_ffill_limit", oracle(f"""SELECT series, ts, last_value(value IGNORE NULLS) OVER {_W} 2 PRECEDING AND CURRENT ROW) AS value FROM dense""",
                                "brand_day", dense=("brand_day", "D")))
def m3(spark, sf):
    return c.ffill(_dense_day(spark, sf), 2)


@query("m3_bfill", oracle(f"""SELECT series, ts, first_value(value IGNORE NULLS) OVER {_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM dense""",
                          "brand_day", dense=("brand_day", "D")))
def m3b(spark, sf):
    return c.bfill(_dense_day(spark, sf))


@query("m4_fill_constant", oracle("SELECT series, ts, coalesce(value, 0) AS value FROM dense", "brand_day", dense=("brand_day", "D")))
def m4(spark, sf):
    return c.fill_constant(_dense_day(spark, sf), 0.0)


def _fill(stat):
    return oracle(f"SELECT d.series, ts, round(coalesce(value, f), 6) AS value FROM dense d JOIN (SELECT series, {stat} AS f FROM brand_day GROUP BY 1) USING (series)",
                  "brand_day", dense=("brand_day", "D"))


@query("m5_fill_mean", _fill("avg(value)"))
def m5(spark, sf):
    return rnd(c.fill_statistic(_dense_day(spark, sf), "mean"))


@query("m5_fill_median", _fill("median(value)"))
def m5m(spark, sf):
    return rnd(c.fill_statistic(_dense_day(spark, sf), "median"))


@query("m5_fill_mode", oracle("""SELECT d.series, ts, coalesce(value, f) AS value FROM dense d JOIN (SELECT series, value AS f FROM
  (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, value) AS rn FROM brand_day GROUP BY 1, 2) WHERE rn = 1) USING (series)""",
  "brand_day", dense=("brand_day", "D")))
def m5o(spark, sf):
    return c.fill_statistic(_dense_day(spark, sf), "mode")


@query("m6_interpolate_linear", oracle(f"""SELECT series, ts, round(coalesce(value, va + (vb - va) * (ps - pa) / (pb - pa), va, vb), 6) AS value FROM (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ps END IGNORE NULLS) OVER {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
    first_value(CASE WHEN value IS NOT NULL THEN ps END IGNORE NULLS) OVER {_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
    last_value(value IGNORE NULLS) OVER {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS va,
    first_value(value IGNORE NULLS) OVER {_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS ps FROM dense))""", "brand_day", dense=("brand_day", "D")))
def m6(spark, sf):
    return rnd(c.interpolate_linear(_dense_day(spark, sf)))


@query("m7_mean_impute", oracle("""SELECT series, ts, round(coalesce(value, avg(value) OVER (PARTITION BY series)), 6) AS value FROM dense""",
                                "brand_flag_week", dense=("brand_flag_week", "W")))
def m7(spark, sf):
    return rnd(c.fill_statistic(_dense_flag(spark, sf), "mean"))


@query("m8_missing_matrix", oracle("""SELECT series, ts, value IS NULL AS missing FROM dense WHERE ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""",
                                   "brand_flag_week", dense=("brand_flag_week", "W")))
def m8(spark, sf):
    return c.missing_matrix(_dense_flag(spark, sf), "1997-01-01", "1998-12-31")


@query("m9_descriptive_stats", oracle(f"""SELECT series, count(value) AS count, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, min(value) AS min,
  {r('quantile_cont(value, 0.25)', 'p25')}, {r('quantile_cont(value, 0.5)', 'p50')}, {r('quantile_cont(value, 0.75)', 'p75')}, max(value) AS max
  FROM brand_day GROUP BY 1""", "brand_day"))
def m9(spark, sf):
    return rnd(c.descriptive_stats(b.brand_day(spark, sf)))

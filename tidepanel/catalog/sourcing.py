"""Ingest and sink queries. Workbooks are grids that Spark derives from the tables."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidepanel.catalog import base as b
from tidepanel.catalog.base import W_FRI, oracle, query, rnd, table
from tidepanel.operators import clean as c
from tidepanel.operators import growth as g
from tidepanel.operators import panel as p
from tidepanel.operators import properties as pp
from tidepanel.sources import files as fl, ingest as s


def _long_source(spark, sf):
    """Three sheets per vendor from the order and ship tables, as text cells."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_shipdate", "l_orderkey")
    daily = li.select(F.lit("book1").alias("file"), F.lit("钢铁_日度_Wind").alias("sheet"), F.lit(1).alias("source_ord"), F.concat(F.lit("产量：日 "), "l_returnflag").alias("series"),
                      F.to_date("l_shipdate").alias("ts"), F.format_string("%.1f", F.col("l_quantity")).alias("raw"), F.col("l_orderkey").alias("seq"))
    weekly = li.select(F.lit("book1").alias("file"), F.lit("化工_周度_Mysteel").alias("sheet"), F.lit(2).alias("source_ord"), F.concat(F.lit("产量: 周 "), "l_returnflag").alias("series"),
                       F.to_date("l_shipdate").alias("ts"), F.format_string("%.1f", F.col("l_quantity") - 1).alias("raw"), F.col("l_orderkey").alias("seq"))
    o = table(spark, sf, "orders")
    monthly = o.select(F.lit("book2").alias("file"), F.lit("能源_月度_同花顺").alias("sheet"), F.lit(3).alias("source_ord"), F.concat(F.lit("工业增加值 "), F.substring("o_orderpriority", 1, 1)).alias("series"),
                       F.last_day("o_orderdate").alias("ts"), F.format_string("%.2f", F.col("o_totalprice")).alias("raw"), F.col("o_orderkey").alias("seq"))
    return daily.unionByName(weekly).unionByName(monthly)


# duplicate stamps: the row of the largest (seq, value) wins on both sides
_S1 = {"d": """SELECT 'daily' AS freq, '产量: 日 ' || l_returnflag AS series, CAST(l_shipdate AS DATE) AS ts, arg_max(l_quantity, (l_orderkey, l_quantity)) AS value FROM lineitem GROUP BY 2, 3""",
       "w0": """SELECT 'weekly' AS freq, '产量: 周 ' || l_returnflag AS series, CAST(l_shipdate AS DATE) AS ts, arg_max(l_quantity - 1, (l_orderkey, CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity END)) AS v FROM lineitem GROUP BY 2, 3""",
       "m": """SELECT 'monthly' AS freq, '工业增加值 ' || left(o_orderpriority, 1) AS series, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS ts, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 2, 3"""}
_FR = W_FRI.replace("isodow(d)", "isodow(ts)").replace("d +", "ts +")


@query("s1_load_panel", oracle(f"""SELECT freq, series, ts, value FROM d UNION ALL SELECT freq, series, ts, value FROM m
  UNION ALL SELECT 'weekly', series, bin, round(avg(value), 6) FROM (SELECT *, {_FR} AS bin FROM d) GROUP BY 2, 3
  UNION ALL SELECT freq, series, bin, arg_max(v, ts) FROM (SELECT *, {_FR} AS bin FROM w0) GROUP BY 1, 2, 3""",
  ctes={**_S1, "w0": _S1["w0"].replace("arg_max(l_quantity - 1, (l_orderkey, CASE WHEN l_quantity = 1 THEN NULL ELSE l_quantity END)) AS v", "nullif(arg_max(l_quantity - 1, (l_orderkey, coalesce(nullif(l_quantity - 1, 0), -1))), 0) AS v")}))
def s1(spark, sf):
    return rnd(s.load_panel(_long_source(spark, sf))[0])


@query("s1_source_map", """SELECT DISTINCT '产量: 日 ' || l_returnflag AS series, 'book1|钢铁_日度_Wind' AS source FROM lineitem UNION ALL SELECT DISTINCT '产量: 周 ' || l_returnflag, 'book1|化工_周度_Mysteel' FROM lineitem
  UNION ALL SELECT DISTINCT '工业增加值 ' || left(o_orderpriority, 1), 'book2|能源_月度_同花顺' FROM orders""")
def s1m(spark, sf):
    return s.load_panel(_long_source(spark, sf))[1]


def _grid(spark, sf):
    """One grid sheet per market segment and layout: customers are the data rows.
    Row numbers come from the customer key, so no ordering pass is needed."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    on = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int"))
    day = F.lit(None).cast("string")  # the formats vendors mix, and a serial number
    for i, f in enumerate(("yyyy-MM-dd", "yyyy/M/d", "yyyy年M月d日", "yyyyMMdd", "d-MMM-yyyy")):
        day = F.when(F.col("c_custkey") % 6 == i, F.date_format(on, f)).otherwise(day)
    day = F.coalesce(day, F.datediff(on, F.lit("1899-12-30").cast("date")).cast("string"))
    cells = F.array(day, F.format_string("%.2f", F.col("c_acctbal")), F.col("c_nationkey").cast("string"))
    out = None
    T = lambda *x: F.array(*[F.lit(v) for v in x])
    heads = {"ths": [T(None, None, None), T("指标名称", "余额", "国家"), T("频率", "日", "日"), T("单位", "元", "个"), T("指标ID", "M001", "S002")],
             "wind": [T("0", None, None), T("指标名称", "余额", "国家")],
             "steel": [T("钢联数据", None, None), T("指标名称", "余额", "国家"), T("频度", "日", "日"), T("指标描述", "x", "y")],
             "oldid": [T("指标名称", "余额", "国家"), T("S0012345", "a", "b")],
             "plain": [T("指标名称", "余额", "国家")]}
    first = c.agg(F.max("c_custkey"))  # one row
    for sheet, rows in heads.items():
        data = c.select((F.col("c_custkey") + len(rows)).alias("row_no"), cells.alias("cells"))
        head = first.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("row_no"), x.cast("array<string>").alias("cells")) for i, x in enumerate(rows)])).alias("h")).select("h.*")
        part = data.unionByName(head).select(F.lit("book").alias("file"), F.lit(sheet).alias("sheet"), "row_no", "cells")
        out = part if out is None else out.unionByName(part)
    return out


@query("s2_vendor_layout", """SELECT 'book' AS file, sheet, layout, header_row, data_row FROM (VALUES ('ths', 'tonghuashun_new', 1, 5), ('wind', 'wind_new', 1, 2), ('steel', 'mysteel_new', 1, 4),
  ('oldid', 'old_with_id', 0, 2), ('plain', 'old_direct', 0, 1)) t(sheet, layout, header_row, data_row)""")
def s2(spark, sf):
    return s.vendor_layout(_grid(spark, sf))


@query("s2_vendor_grid_ingest", """SELECT sheet, layout, CAST(DATE '2000-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS ts, c_custkey + k AS seq, name AS series, raw
  FROM (VALUES ('ths', 'tonghuashun_new', 5), ('wind', 'wind_new', 2), ('steel', 'mysteel_new', 4), ('oldid', 'old_with_id', 2), ('plain', 'old_direct', 1)) t(sheet, layout, k)
  CROSS JOIN (SELECT c_custkey, '余额' AS name, printf('%.2f', c_acctbal) AS raw FROM customer UNION ALL SELECT c_custkey, '国家', CAST(c_nationkey AS VARCHAR) FROM customer)""")
def s2i(spark, sf):
    return s.vendor_grid_ingest(_grid(spark, sf)).drop("file")


@query("s2_dropped_rows", """SELECT sheet, layout, count(*) AS n_rows, count(*) FILTER (c_custkey % 11 = 0) AS n_dropped FROM customer
  CROSS JOIN (VALUES ('ths', 'tonghuashun_new'), ('wind', 'wind_new'), ('steel', 'mysteel_new'), ('oldid', 'old_with_id'), ('plain', 'old_direct')) t(sheet, layout) GROUP BY 1, 2""")
def s2d(spark, sf):
    grid = _grid(spark, sf)
    heads = F.element_at(F.create_map(*[F.lit(x) for kv in (("ths", 5), ("wind", 2), ("steel", 4), ("oldid", 2), ("plain", 1)) for x in kv]), F.col("sheet"))
    key = F.col("row_no") - heads
    odd = F.when((key >= 0) & (key % 11 == 0), F.array(F.lit("合计"), F.get("cells", F.lit(1)))).otherwise(F.col("cells"))
    return s.dropped_rows(grid.withColumn("cells", odd)).drop("file")


@query("s3_sheet_info", """SELECT sheet, false AS is_target, c_mktsegment AS industry, 'weekly' AS freq_type, 'Wind_' || c_nationkey AS source
  FROM (SELECT DISTINCT c_mktsegment || '_周度_Wind_' || c_nationkey AS sheet, c_mktsegment, c_nationkey FROM customer)
  UNION ALL SELECT DISTINCT c_mktsegment || '-月度', true, c_mktsegment, 'target', NULL FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT DISTINCT c_mktsegment, false, NULL, NULL, NULL FROM customer""")
def s3(spark, sf):
    c = table(spark, sf, "customer")
    sheets = c.select(F.concat("c_mktsegment", F.lit("_周度_Wind_"), F.col("c_nationkey").cast("string")).alias("sheet")).distinct()
    sheets = sheets.unionByName(c.filter("c_mktsegment = 'BUILDING'").select(F.concat("c_mktsegment", F.lit("-月度")).alias("sheet")).distinct())
    sheets = sheets.unionByName(c.select(F.col("c_mktsegment").alias("sheet")).distinct())
    return s.sheet_info(sheets, "building-月度")


@query("s4_industry_of_source", """SELECT source, CASE WHEN source LIKE 'f|%' THEN n_name || '钢' WHEN source LIKE '%|%' THEN split_part(n_name, '_', 1) ELSE split_part(n_name, '_', 1) END AS industry FROM (
  SELECT n_name, 'f|A_' || n_name || '_x' AS source FROM nation WHERE false UNION ALL SELECT replace(n_name, '_', ''), 'f|A_' || replace(n_name, '_', '') || '钢_周度' FROM nation
  UNION ALL SELECT n_name, 'g|' || n_name || '_w' FROM nation UNION ALL SELECT n_name, n_name FROM nation)""")
def s4(spark, sf):
    n = table(spark, sf, "nation")
    src = n.select(F.concat(F.lit("f|A_"), F.replace("n_name", F.lit("_"), F.lit("")), F.lit("钢_周度")).alias("source"))
    src = src.unionByName(n.select(F.concat(F.lit("g|"), "n_name", F.lit("_w")).alias("source"))).unionByName(n.select(F.col("n_name").alias("source")))
    return src.select("source", s.industry_of_source(F.col("source")).alias("industry"))


@query("s5_load_mappings", """SELECT lower(p_name) AS series, arg_max(p_type, p_partkey) FILTER (p_type <> 'PROMO') AS type, arg_max(p_brand, p_partkey) AS industry FROM part GROUP BY 1""")
def s5(spark, sf):
    pt = table(spark, sf, "part")
    sheet = pt.select(F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.when(F.col("p_type") == "PROMO", "nan").otherwise(F.col("p_type")).alias("type"),
                      F.col("p_brand").alias("industry"), F.col("p_partkey").alias("seq"))
    return s.load_mappings(sheet)


@query("s6_read_table", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def s6(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice")
    path = s.scratch_path(spark)
    s.write_summary(o, path)
    return s.read_table(spark, path, "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE")


@F.pandas_udf(StringType())
def _gb18030(lines: pd.Series) -> pd.Series:
    """The bytes of GB18030 as Latin-1 text: Spark's writers know no Chinese charset."""
    return lines.map(lambda x: x.encode("gb18030").decode("latin-1"))


def _write_sheets(spark, grid, chinese=False):
    """``grid(file, sheet, row_no, cells)`` as delimited files, rows in order, one file per sheet;
    NULL cells are empty, those at the end of a row are left out if the array ends before them."""
    path = s.scratch_path(spark)
    line = F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), ",")
    rows = grid.repartition("file", "sheet").sortWithinPartitions("file", "sheet", "row_no")
    rows = rows.select("file", "sheet", (_gb18030(line) if chinese else line).alias("value"))
    out = rows.write.partitionBy("file", "sheet").option("encoding", "iso-8859-1" if chinese else "utf-8")
    out.option("sep", "\x01").option("quote", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _head(grid, rows):
    """``grid`` with head rows (lists of texts or columns over ``file``) before the rows of each sheet."""
    text = lambda cells: F.array(*[c if isinstance(c, F.Column) else F.lit(c) for c in cells]).cast("array<string>")
    lines = F.array(*[F.struct(F.lit(i).cast("long").alias("row_no"), text(x).alias("cells")) for i, x in enumerate(rows)])
    return grid.unionByName(grid.select("file", "sheet").distinct().withColumn("h", F.explode(lines)).select("file", "sheet", "h.*"))


def _brand_sheets(spark, sf, rule, sheet, name, fmt, wind):
    """A workbook per brand: a row per date, a column per return flag."""
    panel = b._brand(spark, sf, rule, ("l_returnflag",))
    part = F.split("series", "/")
    day = panel.groupBy(F.translate(part[0], "#", "-").alias("file"), "ts").agg(*[F.max(F.when(part[1] == x, F.col("value"))).alias(x) for x in "ANR"])
    cells = F.array(F.date_format("ts", fmt), *[F.when(F.col(x).isNotNull(), F.format_string("%.2f", F.col(x))) for x in "ANR"])
    rows = day.select("file", F.lit(sheet).alias("sheet"), (F.datediff("ts", F.lit("1990-01-01").cast("date")) + 10).cast("long").alias("row_no"), cells.alias("cells"))
    names = [s.NAME_CELL, *[F.concat(F.lit(name), "file", F.lit("/" + x)) for x in "ANR"]]
    return _head(rows, [["0", None, None, None], names] if wind else [names])


_S1F = """SELECT replace(b, '#', '-') || '/' || f AS name, ts, max(value) FILTER (flag = f) AS value FROM
  (SELECT split_part(series, '/', 1) AS b, split_part(series, '/', 2) AS flag, ts, value FROM {0}) CROSS JOIN (VALUES ('A'), ('N'), ('R')) x(f) GROUP BY 1, 2"""


@query("s1_files_to_panel", oracle(f"""SELECT 'daily' AS freq, '产量: 日 ' || name AS series, ts, value FROM dd
  UNION ALL SELECT 'weekly', '产量: 日 ' || name, bin, round(avg(value), 6) FROM (SELECT *, {_FR} AS bin FROM dd) GROUP BY 2, 3
  UNION ALL SELECT 'weekly', '产量: 周 ' || name, ts, value FROM ww""", "brand_flag_week",
  ctes={"brand_flag_day": b._brand_sql("d", "p_brand || '/' || l_returnflag"), "dd": _S1F.format("brand_flag_day"), "ww": _S1F.format("brand_flag_week")}))
def s1f(spark, sf):
    """Files of two layouts, encodings and date orders to a panel."""
    daily = _write_sheets(spark, _brand_sheets(spark, sf, "D", "钢铁_日度_Wind", "产量：日 ", "yyyy/M/d", True))
    weekly = _write_sheets(spark, _brand_sheets(spark, sf, "W-FRI", "化工_周度_Mysteel", "产量: 周 ", "dd/MM/yyyy", False), chinese=True)
    return rnd(fl.files_to_panel(spark, [daily, weekly])[0])


@query("s6_read_files", """SELECT o_orderkey // 20000 % 2 = 1 AS is_gb, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, round(o_totalprice, 2) AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN 'short' END AS repaired FROM orders""")
def s6f(spark, sf):
    """Two encodings, two column orders, a title above the header, a header one name short, rows one cell short."""
    o = table(spark, sf, "orders")
    key, gb = F.col("o_orderkey").cast("string"), F.floor(F.col("o_orderkey") / 20000) % 2 == 1
    status = F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus"))
    price, last = F.format_string("%.2f", F.col("o_totalprice")), F.when(F.col("o_orderkey") % 7 != 0, "x")
    rows = o.select(F.format_string("f%08d", F.floor(F.col("o_orderkey") / 20000)).alias("file"), F.lit("订单").alias("sheet"), (F.col("o_orderkey") + 10).alias("row_no"),
                    F.when(gb, F.array(price, key, status, last)).otherwise(F.array(key, status, price, last)).alias("cells"), gb.alias("gb"))
    sides = [_head(rows.filter(~F.col("gb")).drop("gb"), [["导出的订单"], ["编号", "状态", "金额"]]),
             _head(rows.filter("gb").drop("gb"), [["导出的订单"], ["金额", "编号", "状态"]])]
    trim = lambda d: d.withColumn("cells", F.filter("cells", lambda x: x.isNotNull()))
    paths = [_write_sheets(spark, trim(side), chinese) for side, chinese in zip(sides, (False, True))]
    out = fl.read_files(spark, paths, ["编号", "状态", "金额"], skip_rows=[0])
    return out.select((F.col("encoding") == "gb18030").alias("is_gb"), F.col("编号").cast("long").alias("o_orderkey"), F.col("状态").alias("status"),
                      F.col("金额").cast("double").alias("price"), "repaired")


@query("s7_read_indexed", """SELECT CAST(o_orderdate AS DATE) AS ts, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'""")
def s7(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "bad").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"), "o_orderkey", "o_totalprice")
    return s.read_indexed(o, 0, "dd/MM/yyyy")


@query("s8_read_merged", oracle("SELECT series, ts, value FROM brand_month", "brand_month"))
def s8(spark, sf):
    d = b.brand_week(spark, sf).withColumn("freq", F.lit("weekly")).unionByName(b.brand_month(spark, sf).withColumn("freq", F.lit("monthly")))
    path = s.scratch_path(spark)
    s.write_merged(d, path)
    return s.read_merged(spark, path, "monthly").select("series", "ts", "value")


@query("s9_detect_date_range", """SELECT CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS "end", count(DISTINCT o_orderpriority) AS n_sheets FROM orders""")
def s9(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sheet"), F.to_date("o_orderdate").alias("ts"))
    li = table(spark, sf, "lineitem").select(F.lit("Meta mapping").alias("sheet"), F.to_date("l_shipdate").alias("ts"))
    return s.detect_date_range(o.unionByName(li))


@query("s10_write_summary", oracle("""SELECT series, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM nation_week GROUP BY 1""", "nation_week"))
def s10(spark, sf):
    path = s.scratch_path(spark)
    s.write_summary(g.weekly_growth_summary(b.nation_week(spark, sf)).select("series", "last_ts", "last_value"), path)
    return s.read_table(spark, path, "series STRING, last_ts DATE, last_value DOUBLE")


@query("s10_write_source_map", """SELECT DISTINCT 'book|' || p_type AS source, p_brand AS series FROM part""")
def s10m(spark, sf):
    path = s.scratch_path(spark)
    s.write_source_map(table(spark, sf, "part").select(F.concat(F.lit("book|"), "p_type").alias("source"), F.col("p_brand").alias("series")).distinct(), path)
    return spark.read.schema("source STRING, series STRING").json(path)


@query("s11_export_prepared", oracle("SELECT series, industry FROM nation_industry", "nation_industry"))
def s11(spark, sf):
    path = s.scratch_path(spark)
    s.export_prepared({"panel": b.nation_week(spark, sf), "industry_map": b.nation_industry(spark, sf)}, path)
    return s.read_table(spark, f"{path}/industry_map", "series STRING, industry STRING")


@query("s11_export_logs", oracle("""SELECT 'panel' AS output, series, max(ts)::VARCHAR AS detail, count(*) AS n FROM brand_month GROUP BY 2
  UNION ALL SELECT 'industry_map', series, industry, 1 FROM nation_industry
  UNION ALL SELECT 'removal_log', series, 'daily_consecutive_nan', max(step) - 1 FROM (SELECT series, lead(ts) OVER (PARTITION BY series ORDER BY ts) - ts AS step FROM brand_day) GROUP BY 2 HAVING max(step) > 6
  UNION ALL SELECT 'transform_log', series, 'log_diff_still_nonstat', 1 FROM (SELECT DISTINCT series FROM brand_month)""", "brand_day", "brand_month", "nation_industry"))
def s11l(spark, sf):
    """All four outputs written and read back. With a level of 0 no test rejects, so the transform
    log is known; gaps at the end of a series are cut off before the removal log is made."""
    month, day = b.brand_month(spark, sf), b.brand_day(spark, sf)
    last = day.groupBy("series").agg(F.max("ts").alias("last"))
    inside = p.densify(day, "D").join(last, "series").filter("ts <= last").drop("last")
    path = s.scratch_path(spark)
    s.export_prepared({"panel": month, "industry_map": b.nation_industry(spark, sf), "removal_log": c.drop_long_gaps(inside, 6, "daily")[1],
                       "transform_log": pp.ensure_stationary(month, 0.0)[1].select("series", "status")}, path)
    read = lambda name, schema: s.read_table(spark, f"{path}/{name}", schema).withColumn("output", F.lit(name))
    panel = read("panel", "series STRING, ts DATE, value DOUBLE").groupBy("output", "series").agg(F.max("ts").cast("string").alias("detail"), F.count(F.lit(1)).alias("n"))
    one = F.lit(1).cast("long").alias("n")
    return (panel.unionByName(read("industry_map", "series STRING, industry STRING").select("output", "series", F.col("industry").alias("detail"), one))
            .unionByName(read("removal_log", "series STRING, reason STRING, longest_run LONG").select("output", "series", F.col("reason").alias("detail"), F.col("longest_run").alias("n")))
            .unionByName(read("transform_log", "series STRING, status STRING").select("output", "series", F.col("status").alias("detail"), one)))


@query("s12_stage_and_copy", oracle("SELECT series, ts FROM brand_week WHERE ts BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'", "brand_week"))
def s12(spark, sf):
    name = s.stage_dataset(b.brand_week(spark, sf), "staged_brand", ["series", "ts"], "1998-01-01", "1999-12-31")
    return spark.table(s.copy_dataset(spark, name, f"{name}_copy"))


@query("s13_dataset_profile", oracle("""SELECT 'brand_week' AS dataset, count(DISTINCT ts) AS n_rows, count(DISTINCT series) AS n_series, min(ts) AS start, max(ts) AS "end", min(series) AS first_series, max(series) AS last_series,
  'Weekly' AS freq_group, 'W-FRI' AS freq_code FROM brand_week UNION ALL SELECT 'segment_month', count(DISTINCT ts), count(DISTINCT series), min(ts), max(ts), min(series), max(series), 'Monthly', 'M' FROM segment_month""",
  "brand_week", "segment_month"))
def s13(spark, sf):
    d = b.brand_week(spark, sf).withColumn("dataset", F.lit("brand_week")).unionByName(b.segment_month(spark, sf).withColumn("dataset", F.lit("segment_month")))
    return s.dataset_profile(d)


@query("s14_weight_template", """SELECT DISTINCT label, p_name AS series, p_retailprice AS weight, p_partkey FROM (SELECT p_partkey, trim(p_name) AS p_name, p_retailprice, p_brand AS label FROM part
  UNION ALL SELECT p_partkey, trim(p_name), p_retailprice, p_type FROM part WHERE p_size > 10) WHERE p_retailprice IS NOT NULL""".replace(", p_partkey FROM (", " FROM (", 1).replace("SELECT DISTINCT label", "SELECT label", 1))
def s14(spark, sf):
    pt = table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("series"), F.col("p_retailprice").alias("weight"), F.col("p_brand").alias("c1"),
                                         F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(" ").alias("c2"))
    return s.weight_template(pt, ["c1", "c2"])

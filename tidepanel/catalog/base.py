"""Query registry and the panels that the queries derive from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.functions.calendar import bin_label

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def exact_sum(col) -> F.Column:
    """Sum of two-decimal amounts in whole cents: exact, independent of row order,
    and cheaper than decimals."""
    return F.sum(F.rint(F.col(col) * 100).cast("long")) / 100


# ---------------------------------------------------------------- panels

def nation_week(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("series"), bin_label(F.col("l_shipdate"), "W-FRI").alias("ts"))
            .agg(exact_sum("l_extendedprice").alias("value")))


def nation_industry(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_name").alias("series"), F.col("r_name").alias("industry")))


def _brand(spark, sf, rule, extra=()) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_shipdate", *extra)
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    series = F.concat_ws("/", "p_brand", *extra)
    return (li.join(p, li.l_partkey == p.p_partkey)
            .groupBy(series.alias("series"), bin_label(F.col("l_shipdate"), rule).alias("ts"))
            .agg(exact_sum("l_quantity").alias("value")))


def brand_day(spark, sf) -> DataFrame:
    return _brand(spark, sf, "D")


def brand_week(spark, sf) -> DataFrame:
    return _brand(spark, sf, "W-FRI")


def brand_month(spark, sf) -> DataFrame:
    return _brand(spark, sf, "M")


def brand_flag_week(spark, sf) -> DataFrame:
    return _brand(spark, sf, "W-FRI", ("l_returnflag",))


def flag_day(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return (li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"),
                       bin_label(F.col("l_shipdate"), "D").alias("ts"))
            .agg(exact_sum("l_quantity").alias("value")))


def flag_industry(spark, sf) -> DataFrame:
    """Series dimension of ``flag_day``: the return flag is the industry."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("series"),
                     F.col("l_returnflag").alias("industry"))


def segment_month(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_mktsegment").alias("series"), bin_label(F.col("o_orderdate"), "M").alias("ts"))
            .agg(exact_sum("o_totalprice").alias("value")))


def segment_week(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy(F.col("c_mktsegment").alias("series"), bin_label(F.col("o_orderdate"), "W-FRI").alias("ts"))
            .agg(exact_sum("o_totalprice").alias("value")))


def event_day(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return (e.groupBy(F.col("event_type").alias("series"), bin_label(F.col("ts"), "D").alias("ts"))
            .agg(exact_sum("value").alias("value")))


def event_raw(spark, sf) -> DataFrame:
    """Single events: several rows per series and day, ``seq`` is the arrival order."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series"), F.to_date("ts").alias("ts"), "value",
                    F.col("event_id").alias("seq"))


# ---------------------------------------------------------------- the same panels in SQL

def _brand_sql(label: str, series: str = "p_brand") -> str:
    return f"""SELECT {series} AS series, {label} AS ts,
      CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem) JOIN part ON l_partkey = p_partkey
      GROUP BY 1, 2"""


W_FRI = "CAST(d + CAST((12 - isodow(d)) % 7 AS INTEGER) AS DATE)"
MONTH_END = "last_day(d)"

PANELS = {
    "nation_week": f"""SELECT n_name AS series, {W_FRI} AS ts,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "nation_industry": """SELECT n_name AS series, r_name AS industry
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "brand_day": _brand_sql("d"),
    "brand_week": _brand_sql(W_FRI),
    "brand_month": _brand_sql(MONTH_END),
    "brand_flag_week": _brand_sql(W_FRI, "p_brand || '/' || l_returnflag"),
    "flag_day": """SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS ts,
      CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""",
    "flag_industry": """SELECT DISTINCT l_returnflag || l_linestatus AS series,
      l_returnflag AS industry FROM lineitem""",
    "segment_month": f"""SELECT c_mktsegment AS series, {MONTH_END} AS ts,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) JOIN customer ON o_custkey = c_custkey
      GROUP BY 1, 2""",
    "segment_week": f"""SELECT c_mktsegment AS series, {W_FRI} AS ts,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders) JOIN customer ON o_custkey = c_custkey
      GROUP BY 1, 2""",
    "event_day": """SELECT event_type AS series, CAST(ts AS DATE) AS ts,
      CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2""",
    "event_raw": """SELECT event_type AS series, CAST(ts AS DATE) AS ts, value, event_id AS seq
      FROM events""",
}


# dense form of a panel: every calendar label between the panel's bounds for every series
STEPS = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY"}


def dense_sql(panel: str, step: str) -> str:
    if step == "M":
        cal = f"""(SELECT last_day(CAST(g AS DATE)) AS ts FROM (SELECT date_trunc('month', MIN(ts)) lo,
          date_trunc('month', MAX(ts)) hi FROM {panel}), generate_series(lo, hi, INTERVAL 1 MONTH) t(g))"""
    else:
        cal = f"""(SELECT CAST(g AS DATE) AS ts FROM (SELECT MIN(ts) lo, MAX(ts) hi FROM {panel}),
          generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), {STEPS[step]}) t(g))"""
    return f"""SELECT s.series, c.ts, p.value FROM (SELECT DISTINCT series FROM {panel}) s
      CROSS JOIN {cal} c LEFT JOIN {panel} p ON p.series = s.series AND p.ts = c.ts"""


def oracle(body: str, *panels: str, dense: tuple[str, str] | None = None, ctes: dict | None = None) -> str:
    """Assemble an oracle: panel CTEs, an optional dense CTE, extra CTEs, body."""
    parts = [f"{p} AS ({PANELS[p]})" for p in panels]
    if dense:
        parts.append(f"dense AS ({dense_sql(*dense)})")
    parts += [f"{k} AS ({v})" for k, v in (ctes or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rnd(df: DataFrame, places: int = 6, **per_col: int) -> DataFrame:
    """Round every DOUBLE column for display; sums of floats differ in the last bits."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), per_col.get(c, places)) for c in doubles}) if doubles else df


def r(expr: str, alias: str, places: int = 6) -> str:
    return f"round({expr}, {places}) AS {alias}"

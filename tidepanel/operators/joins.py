"""Joins, set operations, dataset comparison and patching.

Long panels here may carry a ``dataset`` column beside (series, ts, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.names import match_key
from tidepanel.operators.frequency import robust_infer, to_daily
from tidepanel.operators.panel import SERIES, keep_one

# ---------------------------------------------------------------- joins


def merge(left: DataFrame, right: DataFrame, how: str = "inner", on: Sequence[str] | None = None,
          left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None,
          suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Column merge of two tables. Missing keys meet missing keys; columns on
    both sides get suffixes; ``cross`` is the plain product a user asks for."""
    lk, rk = list(on or left_on or []), list(on or right_on or [])
    if how != "cross":
        if not lk or len(lk) != len(rk):
            raise ValueError("give the same number of key columns on both sides")
        missing = [k for k in lk if k not in left.columns] + [k for k in rk if k not in right.columns]
        if missing:
            raise ValueError(f"key columns not found: {missing}")
    shared = set(on or [])
    both = (set(left.columns) & set(right.columns)) - shared
    lname = {c: c + suffixes[0] if c in both else c for c in left.columns}
    rname = {c: c + suffixes[1] if c in both else c for c in right.columns}
    a, b = left.alias("l"), right.alias("r")
    if how == "cross":
        joined = a.crossJoin(b)
    else:
        cond = [F.col(f"l.`{x}`").eqNullSafe(F.col(f"r.`{y}`")) for x, y in zip(lk, rk)]
        joined = a.join(b, cond, {"outer": "full_outer"}.get(how, how))
    out: list[Column] = []
    for c in left.columns:
        col = F.col(f"l.`{c}`")
        if c in shared and how in ("right", "outer"):
            col = F.coalesce(col, F.col(f"r.`{c}`"))
        out.append(col.alias(lname[c]))
    out += [F.col(f"r.`{c}`").alias(rname[c]) for c in right.columns if c not in shared]
    return joined.select(*out)


def outer_time_join(left: DataFrame, right: DataFrame, ts: str = "ts") -> DataFrame:
    """All dates of both tables, other columns suffixed ``_left`` and ``_right``."""
    a = left.select(ts, *[F.col(c).alias(f"{c}_left") for c in left.columns if c != ts])
    b = right.select(ts, *[F.col(c).alias(f"{c}_right") for c in right.columns if c != ts])
    return a.join(b, ts, "full_outer")


def merge_as_daily(left: DataFrame, right: DataFrame, how: str = "outer") -> tuple[DataFrame, DataFrame]:
    """(merged, frequency): both panels to daily, series side by side in long
    form with their origin, newest date first; the frequency of the merged dates."""
    sides = [to_daily(d).select("series", "ts", "value", F.lit(s).alias("side")) for d, s in ((left, "left"), (right, "right"))]
    both = sides[0].unionByName(sides[1])
    per_date = both.groupBy("ts").agg(F.bool_or(F.col("side") == "left").alias("l"), F.bool_or(F.col("side") == "right").alias("r"))
    keep = {"inner": F.col("l") & F.col("r"), "left": F.col("l"), "right": F.col("r"), "outer": F.lit(True)}[how]
    dates = per_date.filter(keep).select("ts")
    merged = both.join(dates, "ts", "left_semi")
    # The key comes from a column: a literal one would leave joins without a key in the plan.
    freq = robust_infer(dates.withColumns({"series": F.date_format("ts", "'merged'"), "value": F.lit(1.0)}))
    return merged.orderBy(F.col("ts").desc(), "side", "series"), freq


def _daily_table(d: DataFrame, ts: str) -> DataFrame:
    """A wide table with one row per day of its range: means of the columns, NULL on days without rows."""
    day = d.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias(ts)).agg(*[F.avg(c).alias(c) for c in d.columns if c != ts])
    days = day.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(ts))
    return days.join(day, ts, "left").select(d.columns)


def merge_as_daily_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", ts: str = "ts",
                      suffixes: tuple[str, str] = ("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """(merged, frequency): two wide numeric tables, brought to days and merged on key columns, newest
    date first, one row per date.

    The merged dates are the left ones (``ts``; the right one's becomes ``ts_y``) unless ``ts`` is a key; rows
    without one leave. Of several matches of a date the one of the earliest right date stays (with ``ts`` among several
    keys: the one of the smallest keys). So the right side is reduced to its first row per key before the
    join, and a frequent key (NULL on the filled days) never multiplies rows. Missing keys meet.
    """
    missing = [k for k in on if k not in left.columns or k not in right.columns]
    if missing or not on:
        raise ValueError(f"key columns not found: {missing}")
    a, b = _daily_table(left, ts), _daily_table(right, ts)
    if ts in on:
        out = merge(a, b, how, on=on, suffixes=suffixes).filter(F.col(ts).isNotNull())
        others = [k for k in on if k != ts]
        if others:
            out = keep_one(out.withColumn("_first", F.struct(*others)), [ts], "_first", "first").drop("_first")
    else:
        out = merge(a, keep_one(b, list(on), ts, "first"), "left" if how in ("left", "outer") else "inner", on=on, suffixes=suffixes)
        out = out.withColumnsRenamed({ts + suffixes[0]: ts, ts + suffixes[1]: ts + "_y"})
    freq = robust_infer(out.select(F.date_format(ts, "'merged'").alias("series"), ts, F.lit(1.0).alias("value")))
    return out.orderBy(F.col(ts).desc()), freq


def concat_panels(panels: Sequence[DataFrame]) -> DataFrame:
    """Union of panels; a series name belongs to the first panel that has it."""
    out = None
    for i, p in enumerate(panels):
        d = p.select("series", "ts", "value", F.lit(i).alias("_prio"))
        out = d if out is None else out.unionByName(d)
    return first_source_wins(out, "_prio").drop("_prio")


def first_source_wins(df: DataFrame, prio: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Keep the rows of the lowest ``prio`` per series.

    First the best source per (series, stamp), an aggregate that combines before
    the shuffle however many sources repeat a name; the rest is one calendar per
    series, where the series' best source is a window away. One pass."""
    rest = [c for c in df.columns if c not in (*keys, ts, prio)]
    best = df.groupBy(*keys, ts).agg(F.min(F.struct(prio, *rest)).alias("_b"))
    top = F.min(F.col(f"_b.{prio}")).over(Window.partitionBy(*keys))
    kept = best.withColumn("_top", top).filter(F.col(f"_b.{prio}") == F.col("_top"))
    return kept.select(*[F.col(c) if c in (*keys, ts) else F.col(f"_b.{c}").alias(c) for c in df.columns])


def append(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Rows of both tables; identical columns in identical order required."""
    if top.columns != bottom.columns:
        raise ValueError(f"columns differ: {top.columns} and {bottom.columns}")
    return top.unionAll(bottom)


def asof_value(df: DataFrame, dates: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Latest value at or before each (series, date): both sides meet in one
    stream per series ordered by date, and the last value seen is carried on.

    No range join: the union costs one shuffle on the series."""
    v = df.filter(F.col("value").isNotNull()).select(*keys, "ts", "value", F.col("ts").alias("value_ts"), F.lit(0).alias("_q"))
    q = dates.select(*keys, "ts", F.lit(None).cast("double").alias("value"), F.lit(None).cast("date").alias("value_ts"), F.lit(1).alias("_q"))
    w = Window.partitionBy(*keys).orderBy("ts", "_q").rowsBetween(Window.unboundedPreceding, 0)
    d = v.unionByName(q).withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("value", "value_ts")})
    return d.filter("_q = 1").select(*keys, "ts", "value", "value_ts")


def lookup(df: DataFrame, dim: DataFrame, column: str = "industry", default: str = "未分类") -> DataFrame:
    """Attach a dimension attribute with a default for unknown series."""
    return df.join(dim.select("series", column), "series", "left").withColumn(column, F.coalesce(column, F.lit(default)))


def weekly_with_monthly_target(nowcast: DataFrame, target: DataFrame) -> DataFrame:
    """Weekly rows beside their month's target and the target of the previous
    month present: ``nowcast(ts, value)``, ``target(ts, value)``."""
    m = target.filter(F.col("value").isNotNull()).groupBy(F.trunc("ts", "MM").alias("month")).agg(F.max_by("value", "ts").alias("target"))
    prev = F.lag("target").over(Window.partitionBy(F.lit(1)).orderBy("month"))  # one row per month
    m = m.withColumn("previous_target", prev)
    n = nowcast.filter(F.col("value").isNotNull()).select("ts", F.col("value").alias("nowcast"), F.trunc("ts", "MM").alias("month"))
    return n.join(m, "month")


# ---------------------------------------------------------------- sets and reports

def common_series(obs: DataFrame) -> DataFrame:
    """Series that every dataset of ``obs`` has."""
    per = obs.select("dataset", "series").distinct()
    n = per.agg(F.count_distinct("dataset")).scalar()
    return (per.groupBy("series").agg(F.count(F.lit(1)).alias("n")).select("series", "n", n.alias("all"))
            .filter(F.col("n") == F.col("all")).select("series"))


def index_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dates, summary): stamps only one side has, and the lengths."""
    side = lambda d, n: d.select("ts").distinct().withColumn(n, F.lit(1))
    both = side(a, "a").join(side(b, "b"), "ts", "full_outer")
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("common")
    both = both.select("ts", status.alias("status"))
    s = both.agg(F.count_if(F.col("status") != "only_b").alias("length_a"), F.count_if(F.col("status") != "only_a").alias("length_b"),
                 F.count_if(F.col("status") == "only_a").alias("only_a"), F.count_if(F.col("status") == "only_b").alias("only_b"))
    return both.filter("status <> 'common'"), s


def compare_series(df: DataFrame, base: str, others: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, differences) of one base series against others of the dataset, by default all."""
    chosen = F.col("series") != base if others is None else F.col("series").isin(list(others))
    b = df.filter(F.col("series") == base).select("ts", F.col("value").alias("base"))
    stamps = df.select("ts").distinct().join(b, "ts", "left")
    o = df.filter(chosen).select("series", "ts", F.col("value").alias("other"))
    names = df.filter(chosen).select("series").distinct()
    listed = names.agg(F.collect_list("series")).scalar() if others is None else F.array(*[F.lit(x) for x in others])
    have = stamps.join(o, "ts")  # dates where the other side has a row
    base_only = b.select("ts", "base", F.explode(listed).alias("series")).join(
        o.select("series", "ts"), ["series", "ts"], "left_anti").select("ts", "base", "series", F.lit(None).cast("double").alias("other"))
    rows = have.select("ts", "base", "series", "other").unionByName(base_only).join(names, "series", "left_semi")
    diff = rows.filter(~F.col("base").eqNullSafe(F.col("other"))).withColumn("difference", F.col("base") - F.col("other"))
    n = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("base").eqNullSafe(F.col("other"))).alias("n_different"))
    summary = n.withColumn("identical", F.col("n_different") == 0)
    return summary, diff.select("series", "ts", "base", "other", "difference")


def compare_datasets(obs: DataFrame, order: Sequence[str], kinds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(status per series, differing rows) over datasets in ``order``; the first
    is the reference.

    Per series common to all datasets: first different raw lengths, then
    different types (``kinds(dataset, series, kind)``), then the first dataset
    whose non-missing values differ in number or content. The datasets meet in
    one aggregate on (series, ts) and a second one on the series.
    """
    last = len(order) - 1
    is_in = [F.col("dataset") == d for d in order]
    rows = obs.filter(F.col("dataset").isin(list(order))).groupBy("series", "ts").agg(
        *[F.max(F.when(c, F.col("value"))).alias(f"v{i}") for i, c in enumerate(is_in)],
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(is_in)])
    differs = [~F.col("v0").eqNullSafe(F.col(f"v{i}")) for i in range(1, last + 1)]
    per = rows.groupBy("series").agg(
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(last + 1)], *[F.count(f"v{i}").alias(f"c{i}") for i in range(last + 1)],
        *[F.count_if(d).alias(f"d{i}") for i, d in enumerate(differs, 1)])
    counts = [F.col(f"n{i}") for i in range(last + 1)]
    common = F.least(*counts) > 0 if last else counts[0] > 0
    per = per.filter(common)
    if kinds is not None:
        t = kinds.filter(F.col("dataset").isin(list(order))).groupBy("series").agg((F.count_distinct("kind") > 1).alias("_types"))
        per = per.join(t, "series", "left")
    else:
        per = per.withColumn("_types", F.lit(False))
    first = F.lit(None).cast("struct<i:int,len:boolean,n:bigint>")
    for i in range(last, 0, -1):
        len_differs = F.col("c0") != F.col(f"c{i}")
        hit = F.struct(F.lit(i).alias("i"), len_differs.alias("len"), F.col(f"d{i}").alias("n"))
        first = F.when(len_differs | (F.col(f"d{i}") > 0), hit).otherwise(first)
    per = per.withColumn("_f", first)
    lengths = F.least(*counts) != F.greatest(*counts) if last else F.lit(False)
    status = (F.when(lengths, "original_length_mismatch").when(F.col("_types"), "type_mismatch").when(F.col("_f.len"), "length_mismatch")
              .when(F.col("_f").isNotNull(), "different_values").otherwise("identical"))
    names = F.array(*[F.lit(d) for d in order])
    per = per.withColumn("status", status)
    late = F.col("status").isin("length_mismatch", "different_values")
    out = per.select("series", "status", F.when(late, F.element_at(names, F.col("_f.i") + 1)).alias("dataset"),
                     F.when(F.col("status") == "different_values", F.col("_f.n")).otherwise(0).alias("n_different"))
    side = F.element_at(F.array(*[F.col(f"v{i}") for i in range(last + 1)]), F.col("_i") + 1)
    diff = (rows.join(per.filter(late).select("series", F.col("_f.i").alias("_i")), "series").withColumn("value", side)
            .filter(~F.col("v0").eqNullSafe(F.col("value"))))
    return out, diff.select("series", F.element_at(names, F.col("_i") + 1).alias("dataset"), "ts", F.col("v0").alias("ref"), "value")


def same_values_other_name(df: DataFrame) -> DataFrame:
    """Groups of series with identical content under different names.

    Each row hashes on its own and the hashes combine map-side into two
    independent order-free sums per series, so no series is ever collected.
    Series that share the fingerprint are then compared value by value against
    the first name of their group.
    """
    h = lambda seed: F.xxhash64(F.lit(seed), "ts", F.col("value").isNull(), F.coalesce("value", F.lit(0.0)))
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    prints = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), wide(h(1)).alias("h1"), wide(h(2)).alias("h2"))
    mates = prints.groupBy("n", "h1", "h2").agg(F.min("series").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    cand = prints.join(mates, ["n", "h1", "h2"]).select("first", "series", "n")
    mine = df.join(cand, "series").select("first", "series", "n", "ts", "value")
    lead = df.join(mates.select("first").distinct(), F.col("series") == F.col("first")).select("first", "ts", F.col("value").alias("v"))
    same = (mine.join(lead, ["first", "ts"]).groupBy("first", "series", "n")
            .agg(F.count_if(F.col("value").eqNullSafe(F.col("v"))).alias("eq")).filter("eq = n"))
    size = same.groupBy("first").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return same.join(size, "first").select("first", "series", "group_size")


def patch_series(target: DataFrame, source: DataFrame, mode: str = "fill_missing", dates: Sequence[str] | None = None,
                 keys: Sequence[str] = SERIES) -> tuple[DataFrame, DataFrame]:
    """(patched, change log) on the dates both sides have; missing source values
    never overwrite."""
    src = source.select(*keys, "ts", F.col("value").alias("_new")).filter(F.col("_new").isNotNull())
    d = target.join(src, [*keys, "ts"], "left")
    take = F.col("_new").isNotNull()
    if mode == "fill_missing":
        take &= F.col("value").isNull()
    elif mode == "replace_specific_dates":
        if not dates:
            raise ValueError("replace_specific_dates needs dates")
        take &= F.col("ts").isin([F.lit(x).cast("date") for x in dates])
    elif mode != "replace_all":
        raise ValueError(f"unknown mode {mode!r}")
    log = d.filter(take & ~F.col("value").eqNullSafe(F.col("_new"))).select(*keys, "ts", F.col("value").alias("old_value"), F.col("_new").alias("new_value"))
    return d.withColumn("value", F.when(take, F.col("_new")).otherwise(F.col("value"))).drop("_new"), log


def coverage_report(wanted: DataFrame, loaded: DataFrame, final: DataFrame, removal_log: DataFrame) -> DataFrame:
    """Per indicator name: missing from the data, extra in the data, or loaded
    and removed again with the logged reason; names meet in normal form."""
    key = lambda d, c="name": d.select(match_key(F.col(c)).alias("key")).distinct()
    w, l, f = key(wanted).withColumn("w", F.lit(True)), key(loaded).withColumn("l", F.lit(True)), key(final).withColumn("f", F.lit(True))
    log = removal_log.select(match_key(F.col("name")).alias("key"), "reason").groupBy("key").agg(F.min("reason").alias("reason"))
    d = w.join(l, "key", "full_outer").join(f, "key", "full_outer").join(log, "key", "left")
    status = (F.when(F.col("w") & F.col("l").isNull(), "missing_in_data").when(F.col("w").isNull() & F.col("l"), "extra_in_data")
              .when(F.col("w") & F.col("f").isNull(), "removed").when(F.col("w"), "ok").otherwise("extra_in_final"))
    return d.select(F.col("key").alias("name"), status.alias("status"),
                    F.when(status == "removed", F.coalesce("reason", F.lit("unknown"))).alias("reason"))


def indicators_by_industry(dim: DataFrame, obs: DataFrame) -> DataFrame:
    """Industry and its indicators that exist in the data, in order, one row per
    indicator: an industry of any size stays distributed."""
    have = obs.select("series").distinct()
    return dim.select("industry", "series").distinct().join(have, "series", "left_semi").orderBy("industry", "series")


def dedupe_by_time(df: DataFrame, seq: str, keep: str = "last", keys: Sequence[str] = SERIES) -> DataFrame:
    return keep_one(df, [*keys, "ts"], seq, keep)

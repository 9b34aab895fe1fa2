"""Hand-computed micro panels for the edge rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import cells
from tidepanel.functions.calendar import (
    RULES, bin_label, bin_next, bin_ordinal, bin_sequence, friday_of_iso_week, month_last_friday, nearest_friday,
)
from tidepanel.functions.names import nfkc, normalize_name
from tidepanel.functions.scalars import corr_guarded
from tidepanel.operators.quantile import exact_quantile
from tidepanel.operators import clean, frequency as fr, growth, joins, panel as pn, properties as pr, transforms as tr


def test_contract_nan_inf_zero_and_keep_last(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, 1), float("nan"), 1), ("a", dt.date(2024, 1, 2), float("inf"), 2),
                               ("a", dt.date(2024, 1, 3), 0.0, 3), ("a", dt.date(2024, 1, 4), 1.0, 4), ("a", dt.date(2024, 1, 4), 2.0, 5)],
                              "series string, ts date, value double, seq int")
    got = cells(pn.contract(d, seq="seq", zero_missing=True))
    assert got == {("a", "2024-01-01"): None, ("a", "2024-01-02"): None, ("a", "2024-01-03"): None, ("a", "2024-01-04"): 2.0}
    assert cells(pn.contract(d, seq="seq", keep="first"))[("a", "2024-01-04")] == 1.0


def test_bins_at_week_ends(spark):
    days = ["2024-05-31", "2024-06-01", "2024-06-02", "2024-06-03"]  # Fri Sat Sun Mon
    d = spark.createDataFrame([(dt.date.fromisoformat(x),) for x in days], "ts date")
    got = d.select("ts", bin_label(F.col("ts"), "W-FRI").alias("w"), bin_label(F.col("ts"), "W-MON").alias("m"), bin_label(F.col("ts"), "B").alias("b"),
                   nearest_friday(F.col("ts")).alias("n"), month_last_friday(F.col("ts")).alias("l")).orderBy("ts").collect()
    assert [str(r.w) for r in got] == ["2024-05-31", "2024-06-07", "2024-06-07", "2024-06-07"]
    assert [str(r.m) for r in got] == ["2024-06-03"] * 4
    assert [str(r.b) for r in got] == ["2024-05-31", "2024-05-31", "2024-05-31", "2024-06-03"]
    assert [str(r.n) for r in got] == ["2024-05-31", "2024-05-31", "2024-05-31", "2024-06-07"]
    assert [str(r.l) for r in got] == ["2024-05-31", "2024-06-28", "2024-06-28", "2024-06-28"]


@pytest.mark.parametrize("rule", RULES)
def test_calendar_functions_agree(spark, rule):
    """next, ordinal and sequence describe one calendar."""
    d = spark.sql("select explode(sequence(date'2019-11-20', date'2021-03-10', interval 1 day)) as ts")
    lab = d.select(bin_label(F.col("ts"), rule).alias("x")).distinct()
    lab = lab.select("x", *[bin_next(F.col("x"), rule, n).alias(f"p{n}".replace("-", "m")) for n in (1, -1, 7, -7)], bin_ordinal(F.col("x"), rule).alias("o"))
    rows = lab.orderBy("x").collect()
    pos = {r.x: i for i, r in enumerate(rows)}
    assert [r.o - rows[0].o for r in rows] == list(range(len(rows)))
    for r in rows:
        for n, c in ((1, "p1"), (-1, "pm1"), (7, "p7"), (-7, "pm7")):
            i = pos[r.x] + n
            if 0 <= i < len(rows):
                assert r[c] == rows[i].x
    seq = lab.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(bin_sequence(F.col("a"), F.col("b"), rule).alias("s")).first().s
    assert seq == [r.x for r in rows]


def test_friday_of_iso_week(spark):
    d = spark.createDataFrame([(2020, 53), (2021, 1), (2024, 1)], "y int, w int").select(friday_of_iso_week(F.col("y"), F.col("w")).alias("f"))
    assert [str(r.f) for r in d.collect()] == ["2021-01-01", "2021-01-08", "2024-01-05"]


def test_positional_lag_counts_panel_rows(panel):
    d = panel({"a": {"2024-01-01": 1, "2024-01-03": 3}, "b": {"2024-01-02": 5, "2024-01-03": 6}})
    got = cells(pn.with_position(d).withColumn("value", pn.lag_at("value", 1)))
    assert got == {("a", "2024-01-01"): None, ("a", "2024-01-03"): None, ("b", "2024-01-02"): None, ("b", "2024-01-03"): 5.0}
    dense = pn.densify_union(d)
    assert dense.count() == 6


def test_resample_empty_bins(panel):
    d = panel({"a": {"2024-01-01": 1, "2024-01-15": 2}, "b": {"2024-01-08": None}})
    s = cells(fr.resample(d, "W-FRI", "sum"))
    m = cells(fr.resample(d, "W-FRI", "mean"))
    assert s[("a", "2024-01-12")] == 0.0 and m[("a", "2024-01-12")] is None
    assert len(s) == 6 and s[("b", "2024-01-12")] == 0.0


def test_resample_first_skips_missing(panel):
    d = panel({"a": {"2024-01-01": None, "2024-01-02": 7, "2024-01-03": None}})
    assert cells(fr.resample(d, "W-FRI", "first"))[("a", "2024-01-05")] == 7.0
    assert cells(fr.resample(d, "W-FRI", "last"))[("a", "2024-01-05")] == 7.0


def test_value_align_lends(panel):
    # weeks ending 5, 12, 19, 26 Jan and 2 Feb 2024: counts 2, 0, 3, 1, 0
    d = panel({"a": {"2024-01-02": 1, "2024-01-03": 2, "2024-01-15": 3, "2024-01-16": 4, "2024-01-17": 5, "2024-01-22": 6, "2024-01-30": None}})
    got = cells(fr.value_align(d, "W-FRI"), "value", "event")
    assert got == {("a", "2024-01-05"): (1.0, "first_of_several"), ("a", "2024-01-12"): (3.0, "lent_by_next"), ("a", "2024-01-19"): (5.0, "last_of_several"),
                   ("a", "2024-01-26"): (6.0, "single"), ("a", "2024-02-02"): (None, None)}


def test_missing_profile_and_gaps(panel):
    cellsd = {f"2024-01-{i:02d}": v for i, v in enumerate([None, None, 1, None, None, None, 2, None], 1)}
    d = panel({"a": cellsd, "b": {k: 1 for k in cellsd}})
    r = {x.series: x for x in clean.missing_profile(d).collect()}["a"]
    assert (r.longest_run, r.longest_run_after_first, str(r.first_valid), r.n_values) == (3, 3, "2024-01-03", 2)
    assert r.missing_pct == 75.0 and abs(r.missing_after_first_pct - 400 / 6) < 1e-9
    kept, log = clean.drop_long_gaps(d, 3, "daily")
    assert {x.series for x in kept.select("series").distinct().collect()} == {"b"} and log.first().reason == "daily_consecutive_nan"
    filled = clean.missing_profile(clean.ffill(d)).filter("series = 'a'").first()
    assert filled.longest_run == 2 and filled.longest_run_after_first == 0


def test_interpolation_edges(panel):
    d = panel({"a": {"2024-01-01": None, "2024-01-02": 2, "2024-01-03": None, "2024-01-04": 4, "2024-01-05": None}})
    assert [r.value for r in clean.interpolate_linear(d).orderBy("ts").collect()] == [2.0, 2.0, 3.0, 4.0, 4.0]


def test_growth_zero_and_negative_base(panel):
    d = panel({"z": {"2024-01-05": 0, "2024-01-12": 2}, "n": {"2024-01-05": -2, "2024-01-12": 1}})
    got = {r.series: r.growth_w1 for r in growth.weekly_growth_summary(d).collect()}
    assert got == {"z": None, "n": 1.5}
    d8 = growth.diffusion_index(d, "weekly", "pop").orderBy("ts").collect()
    assert [(r.n_above, r.n_valid, r.diffusion) for r in d8] == [(0, 0, 0.0), (0, 1, 0.0)]


def test_rank_latest_change(panel):
    d = panel({"one": {"2024-01-05": 3}, "zero": {"2024-01-05": 0, "2024-01-12": 2}, "up": {"2024-01-05": 1, "2024-01-12": 2}})
    assert [r.series for r in growth.rank_by_latest_change(d).collect()] == ["zero", "up", "one"]


def test_lag_sign_convention(panel):
    """b repeats a five rows later, so a leads: offset +5; as a candidate for target b, a leads by 5."""
    vals = [((i * 7919) % 101) / 10 for i in range(60)]
    day = lambda i: str(dt.date(2024, 1, 1) + dt.timedelta(days=i))
    d = panel({"a": {day(i): vals[i] for i in range(60)}, "b": {day(i): vals[i - 5] if i >= 5 else None for i in range(60)}})
    cor = {r.offset: r["corr"] for r in pr.lag_correlation(d, "a", 8).collect()}
    assert max(cor, key=lambda k: abs(cor[k])) == 5 and abs(cor[5] - 1) < 1e-9
    best = pr.batch_lag_correlation(d, "b", 8).first()
    assert (best.series, best.lead) == ("a", 5) and abs(best["corr"] - 1) < 1e-9
    both = pr.interpret_lead_lag(pr.lead_lag(d, "a", 8, 5)).first()
    assert (both.corr_offset, both.direction) == (5, "candidate_lags")


def test_constant_series(panel):
    day = lambda i: str(dt.date(2024, 1, 1) + dt.timedelta(days=i))
    d = panel({"c": {day(i): 1 for i in range(30)}, "v": {day(i): i % 7 for i in range(30)}, "e": {day(i): None for i in range(30)}})
    assert all(r["corr"] is None for r in pr.lag_correlation(d, "v", 2).collect())
    log = {r.series: r.status for r in pr.ensure_stationary(d)[1].collect()}
    assert log["c"] == "skipped_constant" and log["e"] == "skipped_empty" and log["v"] in ("level", "diff_still_nonstat", "diff")
    assert {r.std for r in tr.standardise(d).filter("series = 'c'").select("std").distinct().collect()} == {1.0}
    two = d.groupBy("series").agg(corr_guarded(F.col("value"), F.col("value")).alias("c")).collect()
    assert {r.series: r.c is None for r in two}["c"]


def test_win_rate_drops_missing_per_series(panel):
    d = panel({"t": {"2024-01-01": 1, "2024-01-02": None, "2024-01-03": 2, "2024-01-04": 1}, "r": {"2024-01-01": 5, "2024-01-02": 9, "2024-01-03": 8, "2024-01-04": 7}})
    got = pr.win_rate(d, "t", "2024-01-04", ["all"]).first()
    assert (got.n_common, got.n_changes, got.win_rate) == (2, 2, 50.0)


def test_first_name_wins_and_same_values(panel):
    a, b = panel({"x": {"2024-01-01": 1}}), panel({"x": {"2024-01-01": 2, "2024-01-02": 3}, "y": {"2024-01-01": 4}})
    assert cells(joins.concat_panels([a, b])) == {("x", "2024-01-01"): 1.0, ("y", "2024-01-01"): 4.0}
    d = panel({"p": {"2024-01-01": 1, "2024-01-02": None}, "q": {"2024-01-01": 1, "2024-01-02": None}, "r": {"2024-01-01": 1, "2024-01-02": 0}})
    assert {(r["first"], r.series) for r in joins.same_values_other_name(d).collect()} == {("p", "p"), ("p", "q")}


def test_patch_then_compare_is_identical(panel):
    t = panel({"a": {"2024-01-01": None, "2024-01-02": 2, "2024-01-03": 9}})
    s = panel({"a": {"2024-01-01": 1, "2024-01-02": 5, "2024-01-03": None}})
    out, log = joins.patch_series(t, s, "replace_all")
    assert cells(out) == {("a", "2024-01-01"): 1.0, ("a", "2024-01-02"): 5.0, ("a", "2024-01-03"): 9.0}
    assert log.count() == 2
    assert cells(joins.patch_series(t, s)[0]) == {("a", "2024-01-01"): 1.0, ("a", "2024-01-02"): 2.0, ("a", "2024-01-03"): 9.0}
    tag = lambda d, n: d.withColumn("dataset", F.lit(n))
    st = joins.compare_datasets(tag(out, "x").unionByName(tag(out, "y")), ["x", "y"])[0].first()
    assert (st.status, st.n_different) == ("identical", 0)


def test_compare_reports_types(panel):
    tag = lambda d, n: d.withColumn("dataset", F.lit(n))
    d = panel({"a": {"2024-01-01": 1}})
    kinds = d.sparkSession.createDataFrame([("x", "a", "double"), ("y", "a", "string")], "dataset string, series string, kind string")
    assert joins.compare_datasets(tag(d, "x").unionByName(tag(d, "y")), ["x", "y"], kinds)[0].first().status == "type_mismatch"


def test_merge_null_keys_and_checks(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, v string")
    got = sorted(map(tuple, joins.merge(a, b, "outer", on=["k"]).collect()), key=str)
    assert got == sorted([(1, "x", "p"), (None, "y", "q"), (3, None, "r")], key=str)
    assert joins.merge(a, b, "cross").columns == ["k_x", "v_x", "k_y", "v_y"]
    with pytest.raises(ValueError):
        joins.merge(a, b, on=["nope"])
    with pytest.raises(ValueError):
        joins.append(a, b.select("v", "k"))


def test_names(spark):
    d = spark.createDataFrame([("产量（万吨）:  日 ",), ("Ａ  b",)], "n string")
    assert [r[0] for r in d.select(normalize_name(F.col("n"))).collect()] == ["产量(万吨): 日", "Ａ b"]
    assert d.select(nfkc(F.col("n")).alias("n")).collect()[1].n == "A  b"
    names = spark.createDataFrame([("x",), ("x.1",), ("x.2",), ("x_v2",), ("y.3",), ("z",)], "name string")
    got = {r.name: r.new_name for r in clean.dedupe_column_names(names).collect()}
    assert got == {"x": "x_v1", "x.1": "x_v3", "x.2": "x_v4", "x_v2": "x_v2", "y.3": "y_v1", "z": "z"}


def test_match_cascade(spark):
    req = spark.createDataFrame([("CPI",), (" gdp ",), ("产量：钢",), ("ＰＭＩ",), ("steel price",), ("none",)], "name string")
    act = spark.createDataFrame([("CPI", 1), ("GDP", 2), ("产量:钢", 3), ("PMI", 4), ("Steel Price Index", 5)], "name string, ord int")
    got = {r.requested: (r.actual, r["rank"]) for r in clean.match_names(req, act).collect()}
    assert got == {"CPI": ("CPI", 1), " gdp ": ("GDP", 2), "产量：钢": ("产量:钢", 3), "ＰＭＩ": ("PMI", 4), "steel price": ("Steel Price Index", 6), "none": (None, None)}


def test_rename_checks(panel):
    d = panel({"a": {"2024-01-01": 1}, "b": {"2024-01-01": 2}})
    for bad in ({"q": "x"}, {"a": "x", "b": "x"}, {"a": "b"}):
        with pytest.raises(ValueError):
            clean.rename_series(d, bad, ["a", "b"])


@pytest.mark.parametrize("texts,fmt", [(["2024-01-05", "2024-02-09", "bad"], "auto"), (["2024/1/5", "2024/2/9"], "yyyy/M/d"), (["202401", "202402"], "yyyyMM"),
                                       (["2024年1月", "2024年2月"], "yyyy年M月"), (["05/01/2024", "31/12/2024"], "d/M/yyyy"), (["x", "y"], None)])
def test_parse_time(spark, texts, fmt):
    out = clean.parse_time(spark.createDataFrame([(t,) for t in texts], "d string"), "d").collect()
    assert {r.time_format for r in out} == {fmt}
    if fmt:
        assert str(out[0].d).startswith("2024-01-0")


def test_infer_frequency_codes(panel):
    day = lambda i: str(dt.date(2024, 1, 1) + dt.timedelta(days=i))
    week = {str(dt.date(2024, 1, 5) + dt.timedelta(days=7 * i)): 1 for i in range(30)}
    months = {f"{2020 + i // 12}-{i % 12 + 1:02d}-01": 1 for i in range(30)}
    quarters = {x: 1 for x in ("2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31")}
    years = {f"{y}-12-31": 1 for y in range(2018, 2023)}
    business = {day(i): 1 for i in range(40) if (dt.date(2024, 1, 1) + dt.timedelta(days=i)).weekday() < 5}
    odd = {day(i * i): 1 for i in range(12)}
    loose = {k: 1 for i, k in enumerate(week) if i != 11}
    d = panel({"d": {day(i): 1 for i in range(30)}, "w": week, "m": months, "q": quarters, "y": years, "b": business, "o": odd, "l": loose, "two": {day(0): 1, day(9): 1}, "one": {day(0): 1}})
    got = {r.series: (r.freq_group, r.freq_code) for r in fr.infer_frequency(d).collect()}
    assert got == {"d": ("Daily", "D"), "w": ("Weekly", "W-FRI"), "m": ("Monthly", "MS"), "q": ("Quarterly", "Q-DEC"), "y": ("Annual", "A-DEC"), "b": ("Business Daily", "B"),
                   "o": ("Irregular", None), "l": ("Weekly", "W-FRI"), "two": ("Irregular", None), "one": ("Undetermined", None)}


def test_cumulative_skip_missing(panel):
    d = panel({"a": {"2024-01-01": 2, "2024-01-02": None, "2024-01-03": 3}})
    assert [r.value for r in tr.transform(d, "cumprod").orderBy("ts").collect()] == [2.0, None, 6.0]
    assert [r.value for r in tr.transform(d, "divide", constant=0).collect()] == [None] * 3


def test_hot_series_collapses_before_the_shuffle(spark):
    """A third of all rows in one series and day: the bin aggregate is partial."""
    d = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("series"),
                                  F.lit("2024-01-01").cast("date").alias("ts"), F.col("id").cast("double").alias("value"))
    out = fr.resample(d, "W-FRI", "max", dense=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "partial_max" in plan
    assert out.filter("series = 'hot'").first().value == 29997.0  # largest multiple of three


def test_exact_quantile_of_skewed_groups(spark):
    """Outliers push nearly all values into one bucket; ties and even sizes."""
    import statistics

    data = {"flat": [1.0] * 9, "even": [1.0, 2.0, 4.0, 9.0], "tail": [float(i % 97) for i in range(500)] + [1e12], "one": [3.0], "none": [None]}
    d = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "series string, value double")
    got = {r.series: r.quantile for r in exact_quantile(d, ["series"]).collect()}
    assert got == {k: statistics.median(v) for k, v in data.items() if k != "none"}
    q = {r.series: r.quantile for r in exact_quantile(d, ["series"], q=0.25).collect()}
    assert q["even"] == 1.75


def test_each_sheet_has_its_own_order_of_day_and_month(spark):
    from tidepanel.sources import ingest

    dates = {"days": ["03/04/2024", "13/04/2024", "5.6.2024"], "months": ["03/04/2024", "04/13/2024", "13/04/2024"], "open": ["03/04/2024", "2024-05-06", "no date"]}
    grid = [(s, 0, ["day", "x"]) for s in dates] + [(s, i + 1, [d, "1"]) for s, v in dates.items() for i, d in enumerate(v)]
    d = spark.createDataFrame([("f", *r) for r in grid], "file string, sheet string, row_no int, cells array<string>")
    got = {(r.sheet, r.seq): str(r.ts) for r in ingest.vendor_grid_ingest(d).collect()}
    assert got == {("days", 1): "2024-04-03", ("days", 2): "2024-04-13", ("days", 3): "2024-06-05",
                   ("months", 1): "2024-03-04", ("months", 2): "2024-04-13", ("months", 3): "2024-04-13",
                   ("open", 1): "2024-03-04", ("open", 2): "2024-05-06"}
    assert {r.sheet: r.n_dropped for r in ingest.dropped_rows(d).collect()} == {"days": 0, "months": 0, "open": 1}


def test_daily_merge_on_keys(spark):
    day = dt.date
    left = spark.createDataFrame([(day(2024, 1, 1), 1.0, 10.0), (day(2024, 1, 1), 3.0, 20.0), (day(2024, 1, 3), 2.0, 5.0), (None, 2.0, 9.0)], "ts date, k double, v double")
    right = spark.createDataFrame([(day(2024, 2, 1), 2.0, 1.0), (day(2024, 2, 2), 2.0, 2.0), (day(2024, 2, 4), 7.0, 3.0)], "ts date, k double, v double")
    got, freq = joins.merge_as_daily_on(left, right, ["k"], "left")
    # 1 January is the mean of two rows, 2 January a filled day without key: it meets the filled 3 February
    assert [tuple(r) for r in got.collect()] == [(day(2024, 1, 3), 2.0, 5.0, day(2024, 2, 1), 1.0), (day(2024, 1, 2), None, None, day(2024, 2, 3), None),
                                                 (day(2024, 1, 1), 2.0, 15.0, day(2024, 2, 1), 1.0)]
    assert freq.first().frequency == "D" and joins.merge_as_daily_on(left, right, ["k"], "right")[0].count() == 3
    both = joins.merge_as_daily_on(left, right, ["ts", "k"], "outer")[0]
    assert both.count() == 7 and both.columns == ["ts", "k", "v_x", "v_y"] and both.first().ts == day(2024, 2, 4)
    assert joins.merge_as_daily_on(left.limit(0), right, ["k"], "outer")[0].count() == 0
    for keys in ([], ["nope"]):
        with pytest.raises(ValueError):
            joins.merge_as_daily_on(left, right, keys)

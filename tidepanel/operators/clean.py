"""Names, cleaning, time parsing and missing data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.names import nfkc, normalize_punct, strip_suffix
from tidepanel.functions.scalars import zero_is_missing
from tidepanel.operators.panel import SERIES, running_back, series_window

# ---------------------------------------------------------------- names

SUFFIXED = r"^(.+)\.(\d+)$"


def match_names(requested: DataFrame, actual: DataFrame) -> DataFrame:
    """Map requested names to actual ones: the first of exact, lower/trim,
    punctuation, NFKC, both, and substring match that hits.

    ``requested(name)``, ``actual(name, ord)``; the earliest actual name wins a
    tie. Every name carries one key per step, so the whole cascade is a single
    equi-join; in the substring steps the shorter name meets those substrings of
    the longer one that have the length of a name on the other side.
    """
    low = lambda c: F.lower(F.trim(c))

    def keyed(d: DataFrame, other: DataFrame, longer_step: int, shorter_step: int) -> DataFrame:
        n, k = F.col("name"), F.col("_nfkc")
        full = low(normalize_punct(k))
        lengths = other.select(F.length(low(normalize_punct(nfkc(F.col("name"))))).alias("n")).filter("n > 0").agg(F.collect_set("n")).scalar()
        forms = [n, low(n), low(normalize_punct(n)), low(k), full]
        keys = [F.array(*[F.struct(F.lit(i).alias("step"), f.alias("key")) for i, f in enumerate(forms, 1)]),
                F.array(F.struct(F.lit(shorter_step).alias("step"), full.alias("key"))),
                F.transform(_substrings(full, F.col("_lengths")), lambda x: F.struct(F.lit(longer_step).alias("step"), x.alias("key")))]
        return (d.withColumns({"_nfkc": nfkc(n), "_lengths": lengths}).withColumn("k", F.explode(F.concat(*keys)))
                .select(*d.columns, "k.step", "k.key").filter(F.length("key") > 0))
    req = requested.select("name").distinct()
    r = keyed(req, actual, 6, 7).withColumnRenamed("name", "requested")
    a = keyed(actual.select("name", "ord"), req, 7, 6).withColumnRenamed("name", "actual")
    rank = F.least(F.col("step"), F.lit(6)).alias("rank")
    best = r.join(a, ["step", "key"]).groupBy("requested").agg(F.min(F.struct(rank, "ord", "actual")).alias("b"))
    return (req.withColumnRenamed("name", "requested").join(best, "requested", "left")
            .select("requested", F.col("b.actual").alias("actual"), F.col("b.rank").alias("rank")))


def _substrings(c: Column, lengths: Column) -> Column:
    """Distinct substrings of the given lengths."""
    spans = F.transform(F.filter(lengths, lambda n: n <= F.length(c)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    return F.when(F.length(c) > 0, F.array_distinct(F.flatten(spans))).otherwise(F.array().cast("array<string>"))


def rename_series(df: DataFrame, mapping: Mapping[str, str], names: Sequence[str]) -> DataFrame:
    """Rename series after the usual checks against the known ``names``."""
    unknown = [k for k in mapping if k not in names]
    if unknown:
        raise ValueError(f"unknown series: {unknown}")
    new = list(mapping.values())
    doubles = sorted({n for n in new if new.count(n) > 1})
    if doubles:
        raise ValueError(f"several series renamed to {doubles}")
    clash = sorted(set(new) & (set(names) - set(mapping)))
    if clash:
        raise ValueError(f"new names already in use: {clash}")
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn("series", F.coalesce(pairs[F.col("series")], F.col("series")))


def rename_by_text(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("series", F.replace(F.col("series"), F.lit(old), F.lit(new)))


def rename_collisions(names: DataFrame, old: str, new: str) -> DataFrame:
    """Names that a text replacement would merge; rename only when this is empty."""
    d = names.select("series").distinct()
    after = F.replace(F.col("series"), F.lit(old), F.lit(new))
    return (d.groupBy(after.alias("new_name")).agg(F.count(F.lit(1)).alias("n_names"))
            .filter(F.col("n_names") > 1))


def duplicate_names(names: DataFrame) -> DataFrame:
    """(base, n_names, name): names equal after dropping ``.N``, trimming and
    lower-casing, one row per member of a group of two or more."""
    d = names.select("name", F.lower(F.trim(strip_suffix(F.col("name")))).alias("base"))
    groups = d.groupBy("base").agg(F.count(F.lit(1)).alias("n_names")).filter("n_names > 1")
    return d.join(groups, "base").select("base", "n_names", "name")


def _name_parts(names: DataFrame) -> DataFrame:
    suffixed = F.col("name").rlike(SUFFIXED)
    return names.withColumns({
        "base": F.when(suffixed, F.regexp_extract("name", SUFFIXED, 1)).otherwise(F.col("name")),
        "suffix": F.when(suffixed, F.regexp_extract("name", SUFFIXED, 2).cast("long")).otherwise(F.lit(-1))})


def drop_duplicate_columns(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): per base name keep the unsuffixed or lowest ``.N``."""
    parts = _name_parts(names)
    kept = parts.groupBy("base").agg(F.min_by("name", "suffix").alias("name")).select("name")
    return kept, names.select("name").join(kept, "name", "left_anti")


def dedupe_column_names(names: DataFrame) -> DataFrame:
    """(name, new_name): members of a duplicated base become ``base_v1..n``,
    skipping numbers already taken by other names."""
    parts = _name_parts(names.select("name").distinct())
    base = Window.partitionBy("base")
    parts = parts.withColumns({"i": F.row_number().over(base.orderBy("suffix", "name")), "n": F.count(F.lit(1)).over(base)})
    taken = (names.select(F.regexp_extract("name", r"^(.+)_v(\d+)$", 1).alias("base"),
                          F.regexp_extract("name", r"^(.+)_v(\d+)$", 2).alias("_v"))
             .filter(F.col("_v") != "").select("base", F.col("_v").cast("long").alias("v")).filter("v > 0").distinct())
    # The i-th free number is i plus the taken numbers v_1 < v_2 < ... with v_r - r < i:
    # one running count over both kinds of rows, no list of a base's names anywhere.
    taken = taken.withColumn("at", F.col("v") - F.row_number().over(base.orderBy("v"))).select("base", "at", F.lit(1).alias("taken"))
    both = (parts.select("base", F.col("i").cast("long").alias("at"), F.lit(0).alias("taken"), "name", "suffix", "n")
            .unionByName(taken, allowMissingColumns=True))
    skip = F.sum("taken").over(base.orderBy("at", "taken").rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumn("number", F.col("at") + skip).filter("taken = 0")
    needs = (F.col("n") > 1) | (F.col("suffix") >= 0)
    renamed = F.concat("base", F.lit("_v"), F.col("number").cast("string"))
    return d.select("name", F.when(needs, renamed).otherwise(F.col("name")).alias("new_name"))


# ---------------------------------------------------------------- values

def time_filter(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Keep start <= ts <= end, the whole end day included."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1))


def custom_missing(df: DataFrame, values: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """Listed values become NULL, by default in all numeric and text columns.
    Numbers meet numeric columns, all values meet text columns as text."""
    numeric = {"double", "float", "integer", "long", "short", "byte", "decimal"}
    kinds = {f.name: f.dataType.typeName().split("(")[0] for f in df.schema.fields}
    chosen = cols or [n for n, k in kinds.items() if k in numeric or k == "string"]
    numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    out = {}
    for c in chosen:
        bad = numbers if kinds[c] in numeric else [str(v) for v in values]
        if bad:
            out[c] = F.when(~F.col(c).isin(bad), F.col(c))
    return df.withColumns(out)


def zero_to_missing(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withColumn(col, zero_is_missing(F.col(col)))


def clean_numeric_text(c: Column) -> Column:
    """Text such as ``1,234.5%`` to a number without scaling; NULL when it is none."""
    return F.trim(F.translate(c, "%,", "")).try_cast("double")


# Date formats tried in this order after automatic detection, with
# the shape a text must have; the shape test spares the failing parse attempts.
TIME_FORMATS = {
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "yyyyMMdd": r"\d{8}",
    "yyyy-M-d H:m:s": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}",
    "yyyy/M/d H:m:s": r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}",
    "yyyy-M": r"\d{4}-\d{1,2}",
    "yyyyMM": r"\d{6}",
    "yyyy年M月": r"\d{4}年\d{1,2}月",
    "yyyy": r"\d{4}",
    "yyyy年M月d日": r"\d{4}年\d{1,2}月\d{1,2}日",
    "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "d-MMM": r"\d{1,2}-[A-Za-z]{3}",
}
EXCEL_EPOCH = "1899-12-30"
TIME_WORDS = ("日期", "时间", "date", "time", "月份", "年份")


def _shaped(c: Column, fmt: str) -> Column:
    return F.when(c.rlike(f"^{TIME_FORMATS[fmt]}$"), F.try_to_timestamp(c, F.lit(fmt)))


def _time_attempts(name: str, dtype: str) -> list[tuple[str, Column, Column]]:
    """(method, parsed, extra condition) in order of preference."""
    c = F.col(name)
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return [("datetime", c.cast("timestamp"), F.lit(True))]
    if dtype != "string":
        whole = c.cast("int")
        year = F.make_date(whole, F.lit(1), F.lit(1)).cast("timestamp")
        looks_year = F.lit("year" in name.lower() or "年份" in name)
        in_range = F.coalesce(F.min(c) >= 1800, F.lit(False)) & F.coalesce(F.max(c) <= 2200, F.lit(False))
        serial = F.date_add(F.lit(EXCEL_EPOCH).cast("date"), whole).cast("timestamp")
        year = F.when(c.between(1800, 2200), year)
        serial = F.when(c.between(-600000, 2900000), serial)
        out = [("year", year, looks_year & in_range),
               ("excel_serial", serial, ~(looks_year & in_range) & F.coalesce(F.avg(c) > 10000, F.lit(False)))]
        c = c.cast("string")
        return out + [(f, _shaped(c, f), F.lit(True)) for f in ("yyyyMMdd", "yyyyMM", "yyyy")]
    auto = c.try_cast("timestamp")
    formats = [(f, _shaped(c, f), F.lit(True)) for f in TIME_FORMATS]
    return [("auto", F.when(c.rlike(r"^\s*\d{4}-"), auto), F.lit(True)), *formats]


def _time_choice(df: DataFrame, names: Sequence[str], threshold: float) -> DataFrame:
    """One row: per column the first method that parses enough rows, found in a
    single pass over all columns and methods."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    picks = []
    for n in names:
        chain = F.lit(None).cast("string")
        for method, parsed, also in reversed(_time_attempts(n, kinds[n])):
            ok = (F.avg(parsed.isNotNull().cast("int")) >= threshold) & also
            chain = F.when(ok, F.lit(method)).otherwise(chain)
        picks.append(chain.alias(n))
    return df.agg(*picks)


def parse_time(df: DataFrame, name: str, threshold: float = 0.5) -> DataFrame:
    """Replace a column by timestamps, adding ``time_format``: the first method
    that parses at least ``threshold`` of the rows. All methods are scored in
    one aggregate, used as a scalar subquery."""
    kind = dict((f.name, f.dataType.typeName()) for f in df.schema.fields)[name]
    choice = _time_choice(df, [name], threshold).scalar()
    d = df.select("*", choice.alias("time_format"))
    value = F.lit(None).cast("timestamp")
    for method, parsed, _ in reversed(_time_attempts(name, kind)):
        value = F.when(F.col("time_format") == method, parsed).otherwise(value)
    return d.withColumn(name, value)


def identify_time_column(df: DataFrame, names: Sequence[str] | None = None, threshold: float = 0.5) -> str | None:
    """Name of the time column: a parseable one with a telling name, else the
    first parseable one. One row comes back to the driver."""
    names = list(names or df.columns)
    choice = _time_choice(df, names, threshold).first().asDict()
    good = [n for n in names if choice[n] is not None]
    telling = [n for n in good if any(w in n.lower() for w in TIME_WORDS)]
    return (telling or good or [None])[0]


def auto_datetime(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Convert every text or number column with a telling name that parses."""
    for n in [c for c in df.columns if any(w in c.lower() for w in TIME_WORDS)]:
        parsed = parse_time(df, n, threshold)
        df = parsed.drop("time_format")
    return df


def shift_month_sheets(df: DataFrame, pattern: str, sheet: str = "sheet", only: Column | None = None, names: DataFrame | None = None) -> DataFrame:
    """Sheets with a series matching ``pattern`` move, as a whole, to the end of
    the previous month; ``only`` limits this to some rows. The sheets are looked up
    in ``names`` (default: ``df``), a second read of sheet and series names; give the
    rows before any aggregate there, or the aggregate runs twice."""
    only = F.lit(True) if only is None else only
    source = df if names is None else names
    hit = (source.filter(only & F.col("series").contains(pattern)).select(sheet).distinct().withColumn("_hit", F.lit(True)))
    moved = F.when(F.col("_hit") & only, F.last_day(F.add_months("ts", -1))).otherwise(F.col("ts"))
    return df.join(hit, sheet, "left").withColumn("ts", moved).drop("_hit")


# ---------------------------------------------------------------- missing data

def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of one value and the missing run behind it (block 0: leading run).
    Window and both aggregates use the one exchange on the series."""
    block = F.count("value").over(series_window(keys).rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("_block", block).groupBy(*keys, "_block")
            .agg(F.count(F.lit(1)).alias("_n"), F.count("value").alias("_nn"),
                 F.min(F.when(F.col("value").isNotNull(), F.col("ts"))).alias("_first")))


def missing_profile(dense: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    run = F.col("_n") - F.col("_nn")
    after = F.col("_block") > 0
    total, miss = F.sum("_n"), F.sum(run)
    return _islands(dense, keys).groupBy(*keys).agg(
        (F.try_divide(miss * 100.0, total)).alias("missing_pct"),
        F.try_divide(F.sum(F.when(after, run)) * 100.0, F.sum(F.when(after, F.col("_n")))).alias("missing_after_first_pct"),
        F.min("_first").alias("first_valid"), F.sum("_nn").alias("n_values"),
        F.max(run).alias("longest_run"),
        F.coalesce(F.max(F.when(after, run)), F.lit(0)).alias("longest_run_after_first"))


def longest_missing_run(dense: DataFrame, after_first: bool = False, keys: Sequence[str] = SERIES) -> DataFrame:
    col = "longest_run_after_first" if after_first else "longest_run"
    return missing_profile(dense, keys).select(*keys, F.col(col).alias("longest_run"))


def drop_long_gaps(dense: DataFrame, threshold: int, reason: str = "panel", keys: Sequence[str] = SERIES):
    """(kept, log): series whose missing run after the first value reaches the
    threshold leave the panel and enter the log."""
    runs = longest_missing_run(dense, True, keys)
    log = runs.filter(F.col("longest_run") >= threshold).select(*keys, F.lit(f"{reason}_consecutive_nan").alias("reason"),
                                                               "longest_run")
    return dense.join(log.select(*keys), list(keys), "left_anti"), log


def drop_all_null_series(df: DataFrame, keys: Sequence[str] = SERIES):
    """(kept, log): series without a single value are removed."""
    n = df.groupBy(*keys).agg(F.count("value").alias("n"))
    kept = df.join(n.filter("n > 0").select(*keys), list(keys), "left_semi")
    return kept, n.filter("n = 0").select(*keys, F.lit("all_missing").alias("reason"))


def ffill(df: DataFrame, limit: int | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    w = series_window(keys).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return df.withColumn("value", F.last("value", ignorenulls=True).over(w))


def bfill(df: DataFrame, limit: int | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    if limit is not None:
        w = series_window(keys).rowsBetween(0, limit)
        return df.withColumn("value", F.first("value", ignorenulls=True).over(w))
    return df.withColumn("value", F.last("value", ignorenulls=True).over(running_back(keys)))


def fill_constant(df: DataFrame, value: float = 0.0) -> DataFrame:
    return df.withColumn("value", F.coalesce("value", F.lit(float(value))))


def fill_statistic(df: DataFrame, how: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Fill with the series' mean, median or (smallest) mode."""
    if how == "mean":
        fill = F.avg("value").over(Window.partitionBy(*keys))
        return df.withColumn("value", F.coalesce("value", fill))
    if how == "median":
        stat = df.groupBy(*keys).agg(F.median("value").alias("_fill"))
    elif how == "mode":
        counts = df.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
        stat = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "value")).getField("value").alias("_fill"))
    else:
        raise ValueError(f"unknown statistic {how!r}")
    return df.join(stat, list(keys), "left").withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


def interpolate_linear(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Linear between known rows by position; the ends take the nearest value."""
    w = series_window(keys)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_p", F.row_number().over(w))
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("_p").alias("p"), F.col("value").alias("v")))
    d = d.withColumn("_k", known).withColumns({"_a": F.last("_k", ignorenulls=True).over(past),
                                               "_b": F.last("_k", ignorenulls=True).over(running_back(keys))})
    share = F.try_divide((F.col("_p") - F.col("_a.p")).cast("double"), (F.col("_b.p") - F.col("_a.p")).cast("double"))
    line = F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))
    return (d.withColumn("value", F.coalesce("value", line, F.col("_a.v"), F.col("_b.v")))
            .drop("_p", "_k", "_a", "_b"))


def missing_matrix(dense: DataFrame, start=None, end=None) -> DataFrame:
    return time_filter(dense, start, end).select("series", "ts", F.col("value").isNull().alias("missing"))


def descriptive_stats(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return df.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"),
        F.max("value").alias("max"))

"""Reading workbooks and tables into panels, and writing results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.functions.calendar import bin_label
from tidepanel.functions.names import match_key, normalize_name
from tidepanel.functions.scalars import clean_float, zero_is_missing
from tidepanel.operators.clean import shift_month_sheets
from tidepanel.operators.frequency import infer_frequency
from tidepanel.operators.joins import first_source_wins
from tidepanel.operators.panel import keep_one

# Words of vendor workbooks.
FREQ_WORDS = (("周度", "weekly"), ("月度", "monthly"), ("日度", "daily"))
NAME_CELL, FREQ_CELL, FREQ_CELL_2, UNIT_CELL, ID_CELL, MYSTEEL_CELL = "指标名称", "频率", "频度", "单位", "指标ID", "钢联数据"
IP_PATTERN = "工业增加值"
# Texts that mean a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "none",
)
# Sheets that describe others.
META_SHEETS = ("指标体系", "mapping", "meta", "info")


# ---------------------------------------------------------------- sheet names

def sheet_frequency(sheet: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, freq in reversed(FREQ_WORDS):
        out = F.when(sheet.contains(word), freq).otherwise(out)
    return out


def sheet_info(sheets: DataFrame, target_sheet: str | None = None) -> DataFrame:
    """``industry_frequency_source`` sheet names to their parts."""
    name = F.col("sheet")
    parts = F.split(name, "_")
    is_target = F.lower(name) == F.lit(target_sheet.lower()) if target_sheet else F.lit(False)
    word = F.trim(F.get(parts, F.lit(1)))
    freq = F.when(word == "日度", "daily").when(word == "周度", "weekly").when(word == "月度", "monthly_predictor")
    first = F.trim(F.get(parts, F.lit(0)))
    bare = F.trim(F.regexp_replace(F.get(parts, F.lit(0)), "[-_]月度", ""))
    industry = (F.when(is_target, F.when(bare == "", "Macro").otherwise(bare))
                .when((F.size(parts) >= 2) & first.isNotNull(), first))
    source = F.when(F.size(parts) >= 3, F.trim(F.array_join(F.slice(parts, 3, 1000), "_")))
    return sheets.select("sheet", is_target.alias("is_target"), industry.alias("industry"),
                         F.when(is_target, "target").otherwise(freq).alias("freq_type"), F.when(~is_target, source).alias("source"))


def industry_of_source(source: Column) -> Column:
    """``file|sheet``: first ``_`` part of the sheet with a CJK character, else
    the first part."""
    bits = F.split(source, r"\|")
    sheet = F.when(F.size(bits) < 2, source).otherwise(F.get(bits, F.lit(1)))
    parts = F.split(sheet, "_")
    cjk = F.get(F.filter(parts, lambda x: x.rlike("[\\u4e00-\\u9fff]")), F.lit(0))
    first = F.trim(F.get(parts, F.lit(0)))
    return F.coalesce(F.trim(cjk), F.when(first != "", first), F.trim(sheet))


# ---------------------------------------------------------------- vendor grids

def layout_of(cell) -> Column:
    """Layout of a sheet as a struct (layout, header_row, data_row); ``cell(row, column=0)``
    gives a cell of its first five rows."""
    r = [cell(i) for i in range(5)]
    eq = lambda c, v: F.coalesce(c == v, F.lit(False))
    ths = eq(r[1], NAME_CELL) & eq(r[2], FREQ_CELL) & eq(r[3], UNIT_CELL) & eq(r[4], ID_CELL) & F.coalesce(cell(4, 1).rlike("^[MS]"), F.lit(False))
    wind = eq(r[1], NAME_CELL) & (r[0].isNull() | eq(r[0], "0") | eq(r[0], "")) & r[2].isNotNull() & ~r[2].isin(FREQ_CELL, FREQ_CELL_2)
    steel = eq(r[0], MYSTEEL_CELL) & eq(r[1], NAME_CELL) & eq(r[2], FREQ_CELL_2)
    with_id = eq(r[0], NAME_CELL) & F.coalesce(r[1].rlike("^S") & (F.length(r[1]) > 5), F.lit(False))
    # Header row and first data row per vendor layout.
    layouts = [(ths, "tonghuashun_new", 1, 5), (wind, "wind_new", 1, 2), (steel, "mysteel_new", 1, 4),
               (with_id, "old_with_id", 0, 2), (eq(r[0], NAME_CELL), "old_direct", 0, 1)]
    pick = F.struct(F.lit("default").alias("layout"), F.lit(0).alias("header_row"), F.lit(1).alias("data_row"))
    for cond, name, h, d in reversed(layouts):
        pick = F.when(cond, F.struct(F.lit(name).alias("layout"), F.lit(h).alias("header_row"), F.lit(d).alias("data_row"))).otherwise(pick)
    return pick


def vendor_layout(grid: DataFrame) -> DataFrame:
    """Layout per (file, sheet) from its first five rows: name, header row and
    first data row. ``grid(file, sheet, row_no, cells ARRAY)``; the filter on
    ``row_no`` reaches the scan."""
    head = grid.filter(F.col("row_no") <= 4)
    cell = lambda r, c=0: F.max(F.when(F.col("row_no") == r, F.get("cells", F.lit(c))))
    g = head.groupBy("file", "sheet").agg(*[cell(r).alias(f"r{r}") for r in range(5)], cell(4, 1).alias("r4b"))
    pick = layout_of(lambda r, c=0: F.col(f"r{r}b" if c else f"r{r}"))
    return g.select("file", "sheet", pick.alias("p")).select("file", "sheet", "p.*")


# Date formats of grid cells with their shapes, tried in order; a serial number comes
# before them. A format is only tried on texts of its shape: a failing parse is an exception in the JVM.
CELL_DATES = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("yyyy/M/d HH:mm:ss", r"^\d{4}/\d{1,2}/\d{1,2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy.M.d", r"^\d{4}\.\d{1,2}\.\d{1,2}$"), ("yyyy年M月d日", r"^\d{4}年\d{1,2}月\d{1,2}日$"), ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy年M月", r"^\d{4}年\d{1,2}月$"), ("yyyy-M", r"^\d{4}-\d{1,2}$"), ("yyyy/M", r"^\d{4}/\d{1,2}$"),
    ("yyyyMM", r"^\d{6}$"), ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
)


# Fixed value: cells that start with day and month in an order that the cell does not tell.
TWO_WAYS = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"


def cell_date(cell: Column, day_first: Column | None = None) -> Column:
    """Date of a text cell by the first format that fits, or by its serial number. Day and month
    before a year are read in the order ``day_first`` says, or in the other if only that fits."""
    text = F.trim(cell)
    serial = F.when(text.rlike(r"^\d{5}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int")))
    read = lambda t, f: F.try_to_timestamp(t, F.lit(f)).cast("date")
    slashed = F.regexp_replace(text, TWO_WAYS, "$1/$2/$3")
    by_day, by_month = read(slashed, "d/M/yyyy"), read(slashed, "M/d/yyyy")
    first = F.lit(False) if day_first is None else F.coalesce(day_first, F.lit(False))
    left, right = (F.regexp_extract(text, TWO_WAYS, i).try_cast("int") for i in (1, 2))
    day = (right <= 12) & (first | (left > 12))  # the other order if only that has a month
    either = F.when(text.rlike(TWO_WAYS), F.when(day, by_day).otherwise(by_month))
    return F.coalesce(serial, either, *(F.when(text.rlike(shape), read(text, f)) for f, shape in CELL_DATES), text.try_cast("date"))


def day_order(grid: DataFrame) -> DataFrame:
    """(file, sheet, day_first): a sheet writes the day first if more of its cells can only be
    read that way than only the other; one row per sheet, counted before the shuffle."""
    part = lambda i: F.regexp_extract(F.trim(F.get("cells", F.lit(0))), TWO_WAYS, i).try_cast("int")
    return grid.groupBy("file", "sheet").agg((F.count_if(part(1) > 12) > F.count_if(part(2) > 12)).alias("day_first"))


def dropped_rows(grid: DataFrame) -> DataFrame:
    """Per sheet: data rows, and those that :func:`vendor_grid_ingest` leaves out because
    their first cell holds no date."""
    rows = grid.join(vendor_layout(grid).join(day_order(grid), ["file", "sheet"]), ["file", "sheet"]).filter(F.col("row_no") >= F.col("data_row"))
    stamp = cell_date(F.get("cells", F.lit(0)), F.col("day_first"))
    return rows.groupBy("file", "sheet", "layout").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(stamp.isNull()).alias("n_dropped"))


def vendor_grid_ingest(grid: DataFrame) -> DataFrame:
    """Raw grids to long rows (file, sheet, layout, series, ts, raw, seq). Rows without a
    date in the first cell go; :func:`dropped_rows` counts them per sheet. The order of day and
    month is the sheet's (:func:`day_order`)."""
    lay = vendor_layout(grid).join(day_order(grid), ["file", "sheet"])
    head = grid.filter(F.col("row_no") <= 1).join(lay, ["file", "sheet"]).filter(F.col("row_no") == F.col("header_row"))
    head = head.select("file", "sheet", "layout", "data_row", "day_first", F.col("cells").alias("names"))
    rows = grid.join(head, ["file", "sheet"]).filter(F.col("row_no") >= F.col("data_row"))
    stamp = cell_date(F.get("cells", F.lit(0)), F.col("day_first"))
    pairs = F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("cell"))
    out = rows.select("file", "sheet", "layout", stamp.alias("ts"), F.col("row_no").alias("seq"),
                      F.explode(F.slice(pairs, F.lit(2), F.greatest(F.size("names") - 1, F.lit(0)))).alias("p"))
    return (out.select("file", "sheet", "layout", F.col("p.name").alias("series"), "ts", F.col("p.cell").alias("raw"), "seq")
            .filter(F.col("ts").isNotNull() & F.col("series").isNotNull()))


def load_panel(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, source map) from long raw rows ``(file, sheet, source_ord, series,
    ts, raw, seq)``.

    The panel has a ``freq`` column: monthly sheets as delivered, weekly ones at
    Fridays (last), daily ones as they are and once more as weekly means. Bad
    dates drop, text coerces to numbers, zeros are missing, the last duplicate
    date of a sheet wins and a name belongs to the first source that has it.
    """
    d = raw.withColumn("freq", sheet_frequency(F.col("sheet"))).filter(F.col("freq").isNotNull() & F.col("ts").isNotNull())
    value = zero_is_missing(clean_float(F.col("raw").cast("string").try_cast("double")))
    d = d.select("file", "sheet", "source_ord", "freq", F.col("series"), F.col("ts").cast("date").alias("ts"), value.alias("value"), "seq")
    names = d.select(F.struct("file", "sheet").alias("_sheet"), "freq", "series")
    d = keep_one(d, ["file", "sheet", "source_ord", "freq", "series", "ts"], "seq").drop("seq")
    # one pass: every row goes to the bin of its frequency, a daily one also to its week
    d = d.withColumn("_sheet", F.struct("file", "sheet"))
    d = shift_month_sheets(d, IP_PATTERN, "_sheet", F.col("freq") == "monthly", names).drop("_sheet")
    week = bin_label(F.col("ts"), "W-FRI")
    goal = lambda freq, ts, mean: F.struct(F.lit(freq).alias("freq"), ts.alias("bin"), F.lit(mean).alias("mean"))
    goals = (F.when(F.col("freq") == "daily", F.array(goal("daily", F.col("ts"), False), goal("weekly", week, True)))
             .when(F.col("freq") == "weekly", F.array(goal("weekly", week, False)))
             .otherwise(F.array(goal("monthly", F.col("ts"), False))))
    d = d.withColumn("g", F.explode(goals)).withColumn("series", normalize_name(F.col("series")))
    live = F.when(F.col("value").isNotNull(), F.col("ts"))
    every = d.groupBy("file", "sheet", "source_ord", "g.freq", "series", "g.bin", "g.mean").agg(
        F.avg("value").alias("_avg"), F.max_by("value", live).alias("_last"))
    every = every.select("file", "sheet", "source_ord", "freq", "series", F.col("bin").alias("ts"),
                         F.when(F.col("mean"), F.col("_avg")).otherwise(F.col("_last")).alias("value"))
    panel = first_source_wins(every, "source_ord", ("freq", "series"))
    names = raw.filter(sheet_frequency(F.col("sheet")).isNotNull()).select("file", "sheet", "source_ord", normalize_name(F.col("series")).alias("series"))
    source = (names.groupBy("series").agg(F.min(F.struct("source_ord", F.concat_ws("|", "file", "sheet").alias("s"))).alias("m"))
              .select("series", F.col("m.s").alias("source")))
    return panel.select("freq", "series", "ts", "value"), source


def load_mappings(sheet: DataFrame) -> DataFrame:
    """Mapping sheet ``(name, type, industry, seq)`` to one row per normalised
    name: blanks and 'nan' drop, the last duplicate wins."""
    key = match_key(F.col("name"))
    blank = lambda c: F.when(~F.lower(F.trim(F.col(c))).isin("", "nan"), F.trim(F.col(c)))
    d = sheet.select(key.alias("series"), blank("type").alias("type"), blank("industry").alias("industry"), "seq")
    d = d.filter(F.col("series").isNotNull() & ~F.col("series").isin("", "nan"))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq")))
    return d.groupBy("series").agg(last("type").alias("type"), last("industry").alias("industry"))


# ---------------------------------------------------------------- tables

def read_table(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, encoding: str = "UTF-8",
               na_tokens: Sequence[str] = NA_TOKENS, **options) -> DataFrame:
    """CSV with a list of missing-value texts. A schema spares the inference pass;
    without one all columns are text. Files in Chinese encodings, with rows to skip or with
    ragged headers go through ``files.read_files``."""
    r = spark.read.option("header", header).option("encoding", encoding).option("mode", "PERMISSIVE").options(**options)
    d = (r.schema(schema) if schema else r).csv(path)
    text = [f.name for f in d.schema.fields if f.dataType.simpleString() == "string"]
    return d.withColumns({c: F.when(~F.trim(F.col(c)).isin(list(na_tokens)), F.col(c)) for c in text}) if text else d


def read_indexed(df: DataFrame, time_col: str | int, fmt: str | None = None) -> DataFrame:
    """Choose the time column by name or position, coerce it and drop bad dates."""
    name = df.columns[time_col] if isinstance(time_col, int) else time_col
    c = F.col(name)
    ts = c.try_cast("timestamp") if fmt is None else F.try_to_timestamp(c.cast("string"), F.lit(fmt))
    return df.withColumn("ts", F.to_date(ts)).filter(F.col("ts").isNotNull()).drop(*([] if name == "ts" else [name]))


def detect_date_range(rows: DataFrame) -> DataFrame:
    """First and last date over all data sheets ``(sheet, ts)``: mapping sheets,
    sheets under five rows and sheets with ten dates or fewer do not count."""
    meta = F.lit(False)
    for word in META_SHEETS:
        meta = meta | F.lower(F.col("sheet")).contains(word)
    per = (rows.filter(~meta).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("dates"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
           .filter("n >= 5 and dates > 10"))
    return per.agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.count(F.lit(1)).alias("n_sheets"))


def dataset_profile(obs: DataFrame) -> DataFrame:
    """Rows, columns, range, frequency and first and last series per dataset."""
    shape = obs.groupBy("dataset").agg(
        F.count_distinct("ts").alias("n_rows"), F.count_distinct("series").alias("n_series"), F.min("ts").alias("start"),
        F.max("ts").alias("end"), F.min("series").alias("first_series"), F.max("series").alias("last_series"))
    stamps = obs.select("dataset", "ts").distinct().withColumn("value", F.lit(1.0))
    freq = infer_frequency(stamps, ("dataset",)).select("dataset", "freq_group", "freq_code")
    return shape.join(freq, "dataset", "left")


def weight_template(template: DataFrame, categories: Sequence[str]) -> DataFrame:
    """``(series, weight, category columns)`` to (label, series, weight); blank
    and non-numeric rows drop, a label counts once per row."""
    d = template.select(F.trim("series").alias("series"), F.col("weight").cast("string").try_cast("double").alias("weight"),
                        F.array_distinct(F.array(*[F.trim(F.col(c).cast("string")) for c in categories])).alias("_labels"))
    d = d.filter((F.col("series") != "") & F.col("weight").isNotNull())
    return d.select(F.explode("_labels").alias("label"), "series", "weight").filter((F.col("label") != "") & F.col("label").isNotNull())


# ---------------------------------------------------------------- sinks

def write_merged(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel as Parquet partitioned by frequency. Each frequency is spread over
    the writers by series, so one large frequency does not meet one task."""
    panel.repartition("freq", "series").write.mode(mode).partitionBy("freq").parquet(path)


def read_merged(spark: SparkSession, path: str, freq: str | None = None) -> DataFrame:
    """Read a merged panel; a frequency prunes to its partition."""
    d = spark.read.parquet(path)
    return d if freq is None else d.filter(F.col("freq") == freq)


def write_source_map(source: DataFrame, path: str) -> None:
    source.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).csv(path)


def export_prepared(outputs: dict[str, DataFrame], path: str) -> None:
    """Prepared panel, industry map and logs, one CSV folder each."""
    for name, df in outputs.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def stage_dataset(df: DataFrame, name: str, columns: Sequence[str] | None = None, start=None, end=None,
                  ts: str = "ts", persist: bool = False) -> str:
    """Register a projected, time-filtered dataset under a new unique name and
    return that name; ``persist`` writes a catalog table."""
    spark = df.sparkSession
    d = df.select(*columns) if columns else df
    if start is not None:
        d = d.filter(F.col(ts) >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(F.col(ts) < F.date_add(F.lit(end).cast("date"), 1))
    unique, i = name, 1
    while spark.catalog.tableExists(unique):
        i += 1
        unique = f"{name}_{i}"
    d.write.saveAsTable(unique) if persist else d.createOrReplaceTempView(unique)
    return unique


def copy_dataset(spark: SparkSession, name: str, new_name: str, persist: bool = False) -> str:
    return stage_dataset(spark.table(name), new_name, persist=persist)


def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder (local: a temporary one)."""
    from tidepanel.plans.session import shared_folder

    return f"{shared_folder(spark)}/tidepanel-{uuid.uuid4().hex}"

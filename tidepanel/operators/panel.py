"""The long panel contract and the calendar work every operator rests on.

A panel is ``(series, ts DATE, value DOUBLE)`` with at most one row per series
and stamp. A series therefore never has more rows than its calendar has stamps
(a few thousand), whatever the size of the raw facts, so a window partitioned
by series is bounded. ``contract`` gets there by aggregation with map-side
combine: duplicate stamps of a hot series collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidepanel.functions.calendar import bin_next, bin_ordinal, bin_sequence
from tidepanel.functions.scalars import clean_float, zero_is_missing

SERIES = ("series",)


def series_window(keys: Sequence[str] = SERIES, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running_back(keys: Sequence[str] = SERIES, order: str = "ts") -> WindowSpec:
    """From the current row to the end of the series, read backwards: a growing
    frame costs one pass, a shrinking one would be rebuilt for every row."""
    return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)


def contract(df: DataFrame, seq: str | None = None, zero_missing: bool = False,
             keys: Sequence[str] = SERIES, keep: str = "last") -> DataFrame:
    """Clean values and keep one row per (series, ts): last or first by ``seq``."""
    v = clean_float(F.col("value"))
    if zero_missing:
        v = zero_is_missing(v)
    base = df.filter(F.col("ts").isNotNull())
    if seq is None:
        return base.select(*keys, F.col("ts").cast("date").alias("ts"), v.alias("value"))
    return keep_one(base.select(*keys, F.col("ts").cast("date").alias("ts"), v.alias("value"), seq),
                    [*keys, "ts"], seq, keep).drop(seq)


def keep_one(df: DataFrame, keys: Sequence[str], seq: str, keep: str = "last") -> DataFrame:
    """One row per key, the last or first by ``seq``, as an aggregate (no sort,
    duplicates combine before the shuffle)."""
    pick = F.max if keep == "last" else F.min
    rest = [c for c in df.columns if c not in keys and c != seq]
    best = pick(F.struct(seq, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in (seq, *rest)])


def _stamp(v) -> Column | None:
    if v is None or isinstance(v, Column):
        return v
    return F.lit(v).cast("date")


def panel_bounds(df: DataFrame, start=None, end=None, ts: str = "ts") -> tuple[Column, Column]:
    """First and last stamp of the whole panel: the given dates, else one scalar
    subquery (a two-value aggregate, not a join)."""
    lo, hi = _stamp(start), _stamp(end)
    if lo is None or hi is None:
        span = df.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi")).alias("span")).scalar()
        lo = span.getField("lo") if lo is None else lo
        hi = span.getField("hi") if hi is None else hi
    return lo, hi


def densify(df: DataFrame, rule: str, keys: Sequence[str] = SERIES, span: str = "panel",
            start=None, end=None) -> DataFrame:
    """Fill every missing label of ``rule`` with a NULL row.

    Each row emits itself and the gap up to the next row of its series, the
    first and last rows also the gap to the panel bounds: one shuffle on the
    series and no calendar join. ``span="series"`` stops at the own bounds.
    """
    w = series_window(keys)
    nxt, prev = F.lead("ts").over(w), F.lag("ts").over(w)
    rows = df.withColumns({"_next": nxt, "_first": prev.isNull()})
    if span == "panel":
        lo, hi = panel_bounds(df, start, end)
        rows = rows.select("*", lo.alias("_lo"), hi.alias("_hi"))
        last = F.coalesce(bin_next(F.col("_next"), rule, -1), F.greatest("_hi", "ts"))
        first = F.when(F.col("_first"), F.least("_lo", "ts")).otherwise(F.col("ts"))
    else:
        last = F.coalesce(bin_next(F.col("_next"), rule, -1), F.col("ts"))
        first = F.col("ts")
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    out = rows.select(*keys, *rest, F.col("ts").alias("_own"),
                      F.explode(bin_sequence(first, last, rule)).alias("ts"))
    kept = [F.when(F.col("ts") == F.col("_own"), F.col(c)).alias(c) for c in rest]
    return out.select(*keys, "ts", *kept)


def densify_union(df: DataFrame, keys: Sequence[str] = SERIES, rule: str = "D") -> DataFrame:
    """Give every series the union of all stamps seen in the panel, plus ``pos``.

    The panel-wide index of a wide frame: positional shifts count its rows.
    The gaps come from :func:`densify`; the equi-join on ``ts`` keeps the stamps
    that occur and numbers them.
    """
    return densify(df, rule, keys).join(union_index(df), "ts").select(*keys, "ts", "value", "pos")


def union_index(df: DataFrame) -> DataFrame:
    """(ts, pos): the distinct stamps of the panel, numbered. One row per stamp,
    so the single ordered partition is as long as the calendar."""
    stamps = df.select("ts").distinct()
    return stamps.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("ts")))


def with_position(df: DataFrame, rule: str | None = None) -> DataFrame:
    """Attach the positional index: arithmetic for a regular calendar ``rule``,
    else the union index of the panel."""
    if rule is not None:
        return df.withColumn("pos", bin_ordinal(F.col("ts"), rule))
    return df.join(union_index(df), "ts")


def lag_at(value: str, n: int, keys: Sequence[str] = SERIES, pos: str = "pos") -> Column:
    """Value exactly ``n`` positions earlier, without densifying: a range frame
    of width one over the position."""
    w = Window.partitionBy(*keys).orderBy(pos).rangeBetween(-n, -n)
    return F.first(value).over(w)


def to_wide(df: DataFrame, names: Sequence[str], index: str = "ts") -> DataFrame:
    """Long to wide for the edge of the system; the names are given."""
    return df.groupBy(index).pivot("series", list(names)).agg(F.first("value", ignorenulls=True))


def from_wide(df: DataFrame, index: str, names: Sequence[str]) -> DataFrame:
    """Wide to long: one unpivot, text or numbers become DOUBLE or NULL."""
    cols = [F.col(f"`{n}`").cast("string").alias(n) for n in names]
    long = df.select(F.col(index).alias("ts"), *cols).unpivot(["ts"], list(names), "series", "raw")
    return long.select("series", "ts", clean_float(F.col("raw").try_cast("double")).alias("value"))

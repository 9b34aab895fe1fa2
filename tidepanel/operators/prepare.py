"""Mixed-frequency model panel and its alignment check."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.calendar import nearest_friday
from tidepanel.operators.clean import drop_all_null_series, drop_long_gaps, time_filter
from tidepanel.operators.frequency import (
    align_month_last_friday, align_nearest_friday, target_bounds, to_weekly_friday,
)
from tidepanel.operators.joins import first_source_wins
from tidepanel.operators.panel import densify
from tidepanel.operators.properties import ensure_stationary
from tidepanel.plans.session import cut_lineage

ROLES = ("target", "target_sheet", "monthly", "daily", "weekly")


def mixed_freq_panel(inputs: Mapping[str, DataFrame], start=None, end=None, max_gap: Mapping[str, int] | None = None,
                     alpha: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panel, transform log, removal log) on common Fridays.

    ``inputs`` maps roles to ``(series, ts, value)`` panels: the target and its
    sheet's predictors snap to the Friday of their week; monthly predictors lose
    series with long gaps, become stationary and move to the month's last
    Friday; daily ones become weekly means, weekly ones keep the last value. A
    name belongs to the first role that has it. The calendar is cut to the wanted
    range, series without values leave, and the daily and weekly series become
    stationary; the other roles pass as they are.
    """
    max_gap = {"monthly": None, "weekly": None, **(max_gap or {})}
    have = [r for r in ROLES if r in inputs]
    parts, removed, logs = [], [], []
    for role in have:
        d = inputs[role].select("series", "ts", "value")
        if role in ("target", "target_sheet"):
            d = align_nearest_friday(d)
        elif role == "monthly":
            d = densify(cut_lineage(_month_end(d)), "M")
            if max_gap["monthly"]:
                d, log = drop_long_gaps(d, max_gap["monthly"], "monthly")
                removed.append(log.select("series", "reason"))
            d, log = ensure_stationary(d, alpha)
            logs.append(log.withColumn("role", F.lit(role)))
            removed.append(_skipped(log))
            d = align_month_last_friday(d)
        else:
            d = to_weekly_friday(d, role, dense=False)
            if max_gap["weekly"]:
                d = cut_lineage(d)
                d, log = drop_long_gaps(densify(d, "W-FRI"), max_gap["weekly"], "weekly")
                removed.append(log.select("series", "reason"))
        parts.append(d.select("series", "ts", "value").withColumn("role", F.lit(role)))
    # the pieces meet once; everything after reads this table
    tagged = None
    for i, p in enumerate(parts):
        q = p.withColumn("prio", F.lit(i))
        tagged = q if tagged is None else tagged.unionByName(q)
    every = cut_lineage(first_source_wins(tagged, "prio").filter(F.col("value").isNotNull()).drop("prio"))
    owner = every.select("series", "role").distinct()
    span = every.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("s")).scalar()
    lo, hi = target_bounds(span.getField("lo"), span.getField("hi"), start, end)
    inside = every.select("*", lo.alias("_lo"), hi.alias("_hi")).filter(F.col("ts").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    dense = densify(inside.select("series", "ts", "value"), "W-FRI", start=lo, end=hi)
    _, empty = drop_all_null_series(every.select("series").distinct().join(inside.select("series", "value"), "series", "left").select("series", "value"))
    removed.append(empty.select("series", "reason"))
    fixed = owner.filter(~F.col("role").isin("daily", "weekly")).select("series")
    panel, log = ensure_stationary(dense, alpha, skip=fixed)
    logs.append(log.join(owner, "series"))
    removed.append(_skipped(log))
    return panel.join(owner, "series"), _stack(logs), _stack(removed)


def _month_end(d: DataFrame) -> DataFrame:
    return d.withColumn("_m", F.last_day("ts")).groupBy("series", "_m").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("value")).select("series", F.col("_m").alias("ts"), "value")


def _skipped(log: DataFrame) -> DataFrame:
    gone = F.col("status").startswith("skipped_") & (F.col("status") != "skipped_by_request")
    return log.filter(gone).select("series", F.col("status").alias("reason"))


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(out.columns))
    return out


def check_alignment(prepared: DataFrame, raw: DataFrame, start=None, end=None, tolerance: float = 1e-6) -> DataFrame:
    """Prepared values must equal a raw value whose Friday matches. Reports
    ``misaligned`` (no raw value for that Friday equals it), ``unexpected`` (no
    raw value for that Friday at all) and ``missing`` (raw Friday inside the
    prepared range without a value)."""
    r = raw.filter(F.col("value").isNotNull()).select("series", nearest_friday(F.col("ts")).alias("ts"), F.col("value").alias("raw"))
    p = time_filter(prepared.filter(F.col("value").isNotNull()), start, end).select("series", "ts", "value")
    near = F.abs(F.col("value") - F.col("raw")) <= tolerance + tolerance * F.abs("raw")
    span = p.groupBy("series").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    d = p.join(r, ["series", "ts"], "full_outer").groupBy("series", "ts").agg(
        F.max("value").alias("value"), F.max("raw").alias("raw"), F.bool_or(near).alias("ok"))
    d = d.join(span, "series").filter(F.col("ts").between(F.col("lo"), F.col("hi")))
    status = (F.when(F.col("value").isNull(), "missing").when(F.col("raw").isNull(), "unexpected")
              .when(~F.col("ok"), "misaligned").otherwise("ok"))
    return d.select("series", "ts", "value", status.alias("status")).filter("status <> 'ok'")

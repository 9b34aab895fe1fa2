"""Mixing sources to target weights by cube-method balanced sampling (operator 10).

Targets: sources in code point order (NULL last) weigh 5, 2, 1, repeating, and share all
words; a target stops at ``most`` times its source's size and the excess is shared again.
A document of a source with rate ``r = target / size`` is taken ``floor(r)`` times for
certain and once more with probability ``r - floor(r)``. The cube method turns these
probabilities into 0 or 1: it moves them along the null space of the two balancing
constraints (words and documents of the source) until one more is 0 or 1. Every move keeps
both totals, so only two probabilities remain that no move can round.

The flight runs in blocks of about ``BLOCK`` documents, chosen by hash. Of each source a block
keeps ``RESERVE`` documents of all lengths open; they and the two that it could not round fly
on in groups of ``FAN`` blocks, level by level, until one group per source is left. Long
documents are rounded first and the reserve makes up for them, so what the landing rounds to
the smallest error in words is short. Random signs come from a seed and the
block's number, and a block flies from its longest document to its shortest (ties by hash), so
reruns agree and what is left to land is mostly short.

Edge cases: documents without words (or text) have size 0 and are never taken; a NULL
source is a source of its own; with no words at all every target is 0; rows with a NULL or
repeated ``doc_id`` are units like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import cut_lineage, join_checked, text_bytes

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 2000
FAN = 64
RESERVE = 32
SEED = 20
EPS = 1e-9


def sizes(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The columns ``keep``, the number of words as ``size`` and a hash of the row as ``unit``."""
    src = docs.select(*keep, F.xxhash64(*keep, text).alias("unit"), text_bytes(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(t.split()) for t in b.column(len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "unit", "size"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    return src.mapInArrow(run, ", ".join([*fields, "size long"]))


def positions(values: DataFrame, col: str) -> DataFrame:
    """Distinct values with their position in ascending order, NULL last. Each task counts
    its own range; only the ranges' counts are added up in one place."""
    local = cut_lineage(values.select(col).distinct()
                        .repartitionByRange(F.col(col).asc_nulls_last()).sortWithinPartitions(F.col(col).asc_nulls_last())
                        .withColumn("_id", F.monotonically_increasing_id())
                        .select(col, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    return local.join(before, "_part").select(col, (F.col("_before") + F.col("_at")).alias("position"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``target`` per source (NULL-safe key).

    The shared factor rises as sources reach their limit; each round is one aggregate over
    sources, and a round without a new source at its limit ends it."""
    totals = cut_lineage(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("position") % len(weights) + 1).cast("int"))
    pos = positions(totals, "source").withColumnRenamed("source", "_source")
    table = cut_lineage(totals.join(pos, F.col("source").eqNullSafe(F.col("_source")))
                        .select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        full = F.col("cap") <= F.lit(share) * F.col("w")
        capped, open_w = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if not open_w or not total:
            break
        new = (total - (capped or 0.0)) / open_w
        if new <= share:
            break
        share = new
    return table.select("source", "source_size", F.least("cap", F.lit(share) * F.col("w")).alias("target"))


def flight(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Round ``prob`` to 0 or 1 up to two entries, keeping sum(prob) and sum(prob * size).

    The direction of a move is the first open entry's unit vector, projected on the null
    space of both totals: that entry is rounded and all others make up for it a little. An
    entry far longer than all others has no such direction; with ``land`` (nothing comes
    after) it is rounded at once and the others' probabilities take over its words."""
    x = np.where(prob < EPS, 0.0, np.where(prob > 1 - EPS, 1.0, prob))
    at = np.flatnonzero((x > 0) & (x < 1))
    y, s = x[at], size[at].astype(float)
    while len(y) > 1:
        n, d = len(y), s - s.mean()
        v = float(d @ d)
        uneven = v > EPS * float(s @ s)
        if uneven and n == 2:
            break
        free = 1 - 1 / n - (d * d / v if uneven else 0.0) * np.ones(n)
        k = 0 if free[0] > 0.05 else int(free.argmax())
        if land and k:
            up = rng.random() < y[0]
            x[at[0]], rest = float(up), (y[0] - up) * s[0]
            at, y, s = at[1:], y[1:], s[1:]
            for _ in range(8):  # shares in proportion to size; full ones leave the rest to others
                room = np.where(rest > 0, 1 - y, y)
                w = s * (room > EPS)
                if abs(rest) < EPS or not w.any():
                    break
                step = np.minimum(room, abs(rest) * w / (w * s).sum()) * np.sign(rest)
                y, rest = y + step, rest - float((step * s).sum())
            fixed = (y < EPS) | (y > 1 - EPS)
            x[at[fixed]] = np.round(y[fixed])
            at, y, s = at[~fixed], y[~fixed], s[~fixed]
            continue
        u = np.full(n, -1 / n) - (d[k] / v * d if uneven else 0.0)
        u[k] += 1
        u[np.abs(u) < 1e-13] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.nanmin(np.where(u > 0, (1 - y) / u, np.where(u < 0, -y / u, np.inf)))
            down = np.nanmin(np.where(u > 0, y / u, np.where(u < 0, (y - 1) / u, np.inf)))
        y = y + (up if rng.random() * (up + down) < down else -down) * u
        fixed = (y < EPS) | (y > 1 - EPS)
        x[at[fixed]] = np.round(y[fixed])
        at, y, s = at[~fixed], y[~fixed], s[~fixed]
    x[at] = y
    return x


def landing(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Round the few open entries: the corner with the smallest error in size, then in count."""
    x = prob.copy()
    at = np.flatnonzero((x > 0) & (x < 1))
    if len(at):
        want, number = float((size[at] * x[at]).sum()), float(x[at].sum())
        corners = [[k >> j & 1 for j in range(len(at))] for k in range(1 << len(at))]
        x[at] = min(corners, key=lambda c: (abs(float((size[at] * c).sum()) - want), abs(sum(c) - number), c))
    return x


def _fly(seed: int, depth: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """One block's flight (and landing at the last level), source by source."""

    def fly(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("source", "ascending"), ("size", "descending"), ("unit", "ascending")])
        rng = np.random.default_rng([seed, depth, rows.column("_block")[0].as_py()])
        x, size = rows.column("_x").to_numpy().copy(), rows.column("size").to_numpy()
        source = pa.compute.rank(rows.column("source"), tiebreaker="min").to_numpy()
        edge = np.flatnonzero(np.diff(source)) + 1
        for a, b in zip([0, *edge], [*edge, len(x)]):
            at = np.arange(a, b)
            if not last:  # evenly over the lengths
                at = np.delete(at, np.linspace(0, b - a - 1, RESERVE).astype(int)) if b - a > RESERVE else at[:0]
            x[at] = flight(size[at], x[at], rng, last)
            if last:
                x[at] = landing(size[at], x[at])
        return rows.set_column(rows.column_names.index("_x"), "_x", pa.array(x))

    return fly


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", weights: tuple[float, ...] = WEIGHTS,
        most: float = MOST, block: int = BLOCK, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """The columns ``keep``, ``source``, ``unit``, ``size``, ``source_size``, ``target`` and
    ``copies``: how often the mix takes the document."""
    cols = (*(k for k in keep if k != "source"), "source")
    sized = cut_lineage(sizes(docs, cols, text))
    goal = targets(sized, weights, most).withColumnRenamed("source", "_source")
    units = (sized.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("_rate", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
             .withColumn("_rate", F.when(F.abs(F.col("_rate") - F.round("_rate")) < EPS, F.round("_rate")).otherwise(F.col("_rate")))
             .withColumns({"_whole": F.floor("_rate").cast("int"), "_x": F.col("_rate") - F.floor("_rate")}).drop("_rate"))
    blocks, sources = max(1, math.ceil(sized.count() / block)), max(1, goal.count())
    level = units.withColumn("_block", F.pmod(F.xxhash64(F.col("unit"), F.lit(seed)), F.lit(blocks)).cast("long"))
    schema = level.schema
    keys: tuple[str, ...] = ("_block",)
    done = None
    depth = 0
    while True:
        last = blocks == 1
        depth += 1

        groups = blocks if depth == 1 else blocks * sources  # AQE must not fold them: the work per group is not in its bytes
        flown = cut_lineage(level.repartition(groups, *keys).groupBy(*keys).applyInArrow(_fly(seed, depth, last), schema))
        open_ = (F.col("_x") > 0) & (F.col("_x") < 1)
        closed = flown.filter(~open_)
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        blocks = math.ceil(blocks / fan)
        level = flown.filter(open_).withColumn("_block", F.floor(F.col("_block") / fan).cast("long"))
        keys = ("source", "_block")
    return done.withColumn("copies", F.col("_whole") + F.col("_x").cast("int")).drop("_whole", "_x", "_block")


def take(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns.

    The mix is decided on ids, sizes and row hashes; texts meet the result in one join, a
    broadcast while the decisions are few. Rows of equal id, source and text share their copies,
    which add up; the first of them by its JSON text stands for all. The rows travel in one struct,
    so no column's name can clash."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", "source", text).alias("unit"), "doc_id", "source")
    taken = (mix(docs, text=text, **options).groupBy("unit", "doc_id", "source").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("rows"))
             .filter("copies > 0").select(*(F.col(c).alias(f"_{c}") for c in ("unit", "doc_id", "source")), "copies", "rows"))
    same = (F.col("unit") == F.col("_unit")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
    taken = cut_lineage(taken)
    found = join_checked(held, taken, same).select("row", "unit", "doc_id", "source", "copies", "rows")
    if not taken.filter("rows > 1").isEmpty():
        one = found.filter("rows > 1").groupBy("unit", "doc_id", "source", "copies", "rows").agg(F.min_by("row", F.to_json("row")).alias("row"))
        found = found.filter("rows = 1").unionByName(one)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")

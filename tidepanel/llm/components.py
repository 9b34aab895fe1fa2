"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``v, comp`` for every vertex of the undirected edges ``a, b`` that is not the smallest
    of its component; ``comp`` is the smallest.

    Alternating large-star and small-star steps: each links neighbours to the smallest one
    nearby, with aggregates and equi-joins, in a logarithmic number of rounds. A round's edges
    are written to the shared folder; rounds end when a round changes nothing."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = cut_lineage(now)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.u", "e.v").filter("u <> v").distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("comp"))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free fingerprint of them."""
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], int(r[1] or 0)

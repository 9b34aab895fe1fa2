"""Helpers of the operators: texts as bytes, words, seeded picks and document shares.

Texts travel to Python as UTF-8 bytes: ``bytes.split()`` separates at exactly the
characters 0x20 and 0x09-0x0D, and ``bytes.lower()`` lowers exactly A-Z, which are the
rules of the word definitions used here.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.plans.session import cut_lineage

__all__ = ["cut_lineage", "fold", "join_checked", "rows_of", "table", "text_bytes", "text_total", "by_bytes", "word_hash", "mix64"]


BATCH_BYTES = "8m"


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bound_batches(spark: SparkSession | None) -> None:
    """Texts go to Python in Arrow batches by bytes, whatever their length: a session that
    still has the default of 64 MB gets ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(key) == "67108864b":
        spark.conf.set(key, BATCH_BYTES)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; NULL counts as empty."""
    bound_batches(SparkSession.getActiveSession())
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def fold(col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo ``n``; NULL for a NULL id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def rows_of(batch: pa.RecordBatch) -> zip:
    """The rows of an Arrow batch as tuples."""
    return zip(*(c.to_pylist() for c in batch.columns))


def text_total(docs: DataFrame, col: str = "text") -> tuple[int, int]:
    """(rows, bytes of text); one pass without a shuffle of rows."""
    r = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(col))).first()
    return r[0], r[1] or 0


def by_bytes(total: int, per: int, least: int = 1) -> int:
    return max(least, math.ceil(total / per))


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Join with a side that is written, counted, and broadcast only up to ``rows`` rows;
    beyond that Spark shuffles both sides."""
    small = cut_lineage(small)
    return big.join(F.broadcast(small) if small.count() <= rows else small, on, how)


_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_M1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


class word_hash(dict):
    """Word (bytes) to its 64-bit hash. A bounded memo: it starts anew when full,
    which changes no value."""

    def __init__(self, most: int = 100_000):
        from xxhash import xxh64_intdigest

        self.digest, self.most = xxh64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word)
        return h

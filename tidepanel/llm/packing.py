"""Best-fit decreasing packing of tokenised documents into sequences (operator 3).

Lengths are whole numbers up to the sequence length, so the packing itself needs the
number of pieces of each length only: at most ``size`` counts reach the driver. There a
segment tree over the remaining capacities yields the tightest open sequence for the next
length in logarithmic time; pieces of one length that go into alike sequences are placed
at once, which gives the same packing as piece by piece. The result is a list of runs
``(length, first rank) -> sequence, offset``. Every piece learns its rank among the
pieces of its length from counts by (task, length) and looks up its run, on Spark.

Edge cases: a NULL text is an empty one and becomes its end id; rows with a NULL or a
repeated ``doc_id`` are packed like others; texts longer than a sequence are cut into
full pieces, only the first may be shorter; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.common import cut_lineage, rows_of, text_bytes

SIZE = 2048
END = 0
# The published splitting pattern of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(spec: bytes) -> Callable[[str], np.ndarray]:
    """Text to ids by a byte-level BPE vocabulary, the content of a ``tokenizers`` JSON file.

    The JSON's vocabulary numbers its pieces by merge order, so its ids are ranks and a
    rank-based encoder gives the ids of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)`` about four times as fast; tests compare the two.
    """
    import tiktoken

    spec = json.loads(spec)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes shown as themselves
    other = sorted({*range(256)} - {*plain})
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
    to_ids = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
    return lambda text: to_ids(text, allowed_special="all")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece; ``nth`` counts the pieces of a length within a task (``part``)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    stop = np.array([end], "<u4").tobytes()
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value)
        seen = [0] * (size + 1)
        part = TaskContext.get().partitionId()
        for b in batches:
            out = []
            for doc, text in rows_of(b):
                tokens = encode(text.decode("utf-8", "replace")).astype("<u4").tobytes() + stop
                n = len(tokens) // 4
                k = -(-n // size)
                at, length = 0, n - size * (k - 1)
                for p in range(k):
                    out.append((doc, p, at, length, crc32(tokens[4 * at:4 * (at + length)]), part, seen[length]))
                    seen[length] += 1
                    at, length = at + length, size
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return src.mapInArrow(run, PIECES)


class Capacities:
    """Segment tree over the remaining capacities 0..size: which have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _set(self, c: int, on: bool) -> None:
        i = c + self.leaves
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def put(self, c: int, first: int, n: int) -> None:
        """``n`` sequences from ``first`` on now have ``c`` left."""
        if n and c:
            self.runs[c].append((first, n))
            if len(self.runs[c]) == 1:
                self._set(c, True)

    def take(self, c: int) -> tuple[int, int]:
        got = self.runs[c].pop()
        if not self.runs[c]:
            self._set(c, False)
        return got

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of ``least`` or more."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: runs ``(length, first rank, first
    sequence, pieces per sequence, first offset)``, by descending length, ascending rank."""
    tree, out, fresh = Capacities(size), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                c, first = size, fresh
                n = -(-left // (size // length))
                fresh += n
            else:
                first, n = tree.take(c)
            q = c // length
            full = min(n, left // q)
            if full:
                out.append((length, rank, first, q, size - c))
                tree.put(c - q * length, first, full)
                left, rank = left - full * q, rank + full * q
            if full < n:
                rest = min(left, q - 1)
                if rest:
                    out.append((length, rank, first + full, q, size - c))
                    tree.put(c - rest * length, first + full, 1)
                    left, rank = left - rest, rank + rest
                    full += 1
                tree.put(c, first + full, n - full)
    return out


def pack(docs: DataFrame, tokenizer: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``; sequences have no gaps from 0."""
    cut = cut_lineage(pieces(docs, tokenizer, text, size, end))
    by_task = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}  # one row per length at most
    runs = plan(counts, size)
    wide = max(counts.values(), default=0) + 1
    keys = np.array([(size - a) * wide + b for a, b, *_ in runs], np.int64)
    rest = np.array([r[1:] for r in runs], np.int64).reshape(-1, 4)
    before = by_task.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    ranked = (cut.join(before.drop("n"), ["part", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            rank0, first, q, offset = rest[np.searchsorted(keys, (size - length) * wide + rank, "right") - 1].T
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(first + (rank - rank0) // q), pa.array(offset + (rank - rank0) % q * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

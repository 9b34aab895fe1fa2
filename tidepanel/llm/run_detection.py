"""Periodic runs of words by the dictionary of basic factors (operator 13).

A run is a longest stretch of words with smallest period q and at least ``max(LEAST, TIMES * q)``
words. Per power of two b, the dictionary gives each factor of b words a number, equal factors
of a document the same one; those of 2b words come from pairs. A factor's next occurrence at a
distance p of at most 2b proposes the period p: words p apart are equal from there on for b
words. Neighbouring proposals of one period are an arithmetic progression and join.

Nothing is lost: inside a run of period q, at the b with q <= b < 2q, the next occurrence of
every factor is q words on (a nearer one would give a smaller period, by Fine and Wilf), and a
run of 3q words holds such a factor twice. Nothing wrong is proposed: a smaller period of a
proposed stretch would have shown as a nearer occurrence. Numbers that occur once in their
document cannot be part of a repetition, so the dictionary keeps repeated factors only and
usually dies out after a few doublings.

Documents of an Arrow batch are worked on together as one array; a word's first number holds
its document, so no factor matches across documents.

Edge cases: NULL and empty texts have no words, no runs and an empty collapsed text; rows with
a NULL or repeated ``doc_id`` are treated like others; very long texts are searched whole, in
memory in proportion to their words; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.common import rows_of, text_bytes

LEAST = 24
TIMES = 3


def proposals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, p): words from start to stop (exclusive) equal those p further on."""
    out = []
    at, name, b = np.arange(len(words)), words, 1
    while len(at):
        order = np.argsort(name, kind="stable")  # by number, and by place within a number
        name, at = name[order], at[order]
        same = name[1:] == name[:-1]
        gap = at[1:] - at[:-1]
        near = same & (gap <= 2 * b)
        p, start = gap[near], at[:-1][near]
        order = np.lexsort((start, p))
        p, start = p[order], start[order]
        breaks = np.flatnonzero((np.diff(p) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate([[0], breaks]).astype(np.int64)[:len(p)]
        last = np.concatenate([breaks, [len(p)]])[:len(first)] - 1
        out.append((start[first], start[last] + b, p[first]))
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        number = np.cumsum(np.concatenate([[True], ~same]))[again]
        at = at[again]
        table = np.zeros(len(words) + b, np.int64)
        table[at] = number
        at = np.flatnonzero(table[:len(words)])
        second = table[at + b]
        at, second = at[second > 0], second[second > 0]
        name = table[at] * (len(words) + 1) + second
        b *= 2
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) by start, then period; ``words`` are numbers that differ
    between documents."""
    start, stop, p = proposals(words)
    order = np.lexsort((start, p))
    start, stop, p = start[order], stop[order], p[order]
    shift = p * (2 * len(words) + 2)  # one axis for all periods; stretches that touch join
    reach = np.maximum.accumulate(stop + shift)
    first = np.flatnonzero(np.concatenate([[True], (start + shift)[1:] > reach[:-1]])) if len(p) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(p)]])[:len(first)] - 1
    start, stop, p = start[first], (reach - shift)[last], p[first]
    long = stop - start + p >= np.maximum(least, times * p)
    start, stop, p = start[long], stop[long], p[long]
    for way in (-1, 1):  # to the ends of the stretch
        open_ = np.arange(len(p))
        while len(open_):
            i = start[open_] - 1 if way < 0 else stop[open_]
            ok = (i >= 0) & (i + p[open_] < len(words))
            open_, i = open_[ok], i[ok]
            ok = words[i] == words[i + p[open_]]
            open_ = open_[ok]
            (start if way < 0 else stop)[open_] += way
    found = np.unique(np.stack([start, p, stop - start + p], 1), axis=0)
    return found[:, [0, 2, 1]]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period; word numbers from 0) and
    ``collapsed``: the words joined by one space, without those that lie in a run beyond its
    first period."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vocabulary: defaultdict[bytes, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            texts = [t.split() for _, t in rows_of(b)]
            edges = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(edges))
            flat = np.fromiter((vocabulary[w] for words in texts for w in words), np.int64, edges[-1])
            found = runs(doc << 32 | flat, least, times)
            of = np.searchsorted(edges, found[:, 0], "right") - 1
            drop = np.zeros(edges[-1] + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 0] + found[:, 1], -1)
            keep = (np.cumsum(drop) == 0).tolist()
            hit = set(of.tolist())
            left = [b" ".join(compress(w, keep[edges[i]:edges[i + 1]]) if i in hit else w).decode("utf-8", "replace") for i, w in enumerate(texts)]
            cuts = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(found[:, 0] - edges[of]), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(RUN))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(cuts), rows), pa.array(left, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(found: str = "runs") -> Column:
    """The run of greatest exact length / period (ties: smallest start, then period); NULL without runs."""
    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0))

    return F.try_element_at(F.array_sort(found, before), F.lit(1))

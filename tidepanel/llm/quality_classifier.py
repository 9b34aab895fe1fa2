"""Compression classifier for text quality (operator 1).

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text
compresses better with the dictionary of its kind; the difference of the two compressed
sizes, normalised by their sum, becomes a score by a logistic calibration that also knows
the compressed size per byte (repetition) and the length. Texts are compressed whole, in
stretches of ``STRETCH`` bytes that each start with the dictionary, so the difference does
not fade on long texts.

The fit sees a bounded sample, ``PER_CLASS`` labelled rows of each class and texts up to
``FIT_BYTES`` (both parameters). The calibration is cross-fitted: each half of the sample is
measured with dictionaries of the other half; the final dictionaries come from all of it.
Scoring reads every text once, without a shuffle.

Edge cases: a NULL text is an empty one; empty texts get the calibration's value for no
evidence; a NULL ``doc_id`` is scored and not held out; rows are scored each, also repeated
ones; labels other than 0 and 1, or contradicting ones, are not learned from; without labels
of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import fold, text_bytes

PER_CLASS = 1500
FIT_BYTES = 32_768
DICT_BYTES = 65_536
STRETCH = 4096
LEVEL = 3
RIDGE = 0.05
THRESHOLD = 0.7


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int = PER_CLASS,
                    fit_bytes: int = FIT_BYTES) -> DataFrame:
    """``doc_id, y, text`` of up to ``per_class`` rows of each class, picked by hash of the
    id; at most 2 * ``per_class`` rows, so the picked ids may be broadcast. Of several texts
    with one id the first in byte order counts."""
    known = (labels.filter(train & F.col(label).isin(0, 1)).groupBy("doc_id")
             .agg(F.min(label).alias("y"), F.max(label).alias("_max")).filter("y = _max").select("doc_id", "y"))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.filter("y = 0").orderBy(*order).limit(per_class).union(known.filter("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", text_bytes().alias("text")).filter(F.octet_length("text") <= fit_bytes)
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; few samples are taken as they are."""
    pieces = [t[i:i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of a text with each dictionary, as features."""

    def __init__(self, good: bytes, bad: bytes):
        self.press = []
        for d in (good, bad):
            held = zstandard.ZstdCompressionDict(d)
            if d:
                held.precompute_compress(level=LEVEL)
            self.press.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held if d else None, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def of(self, text: bytes) -> tuple[int, int, int]:
        cut = [text[i:i + STRETCH] for i in range(0, len(text), STRETCH)]
        return (*(sum(len(p(c)) for c in cut) for p in self.press), len(text))


def features(sizes: np.ndarray) -> np.ndarray:
    """[1, normalised difference, size per byte, length] and products, from (good, bad, length)."""
    g, b, n = sizes.astype(float).T
    with np.errstate(invalid="ignore", divide="ignore"):
        diff = np.where(g + b > 0, (b - g) / (g + b), 0.0)
        ratio = np.where(n > 0, np.log((g + b) / 2 / n), 0.0)
    size = np.log1p(n) / 10
    return np.stack([np.ones_like(diff), 10 * diff, ratio, size, 10 * diff * ratio, 10 * diff * size, ratio * ratio, ratio * size], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps; the first column is not shrunk."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge * weight.sum() / len(y))
    pen[0] = 1e-9
    loss = lambda v: float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + (pen * v * v).sum() / 2)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (p - y)) + pen * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), grad)
        t = 1.0
        while (new := loss(w - t * step)) > now and t > 1e-4:
            t /= 2
        w = w - t * step
        if now - new < 1e-9 * abs(now):
            break
        now = new
    return w


def fit(sample: list[tuple[int, bytes]], share: float | None = None) -> tuple[bytes, bytes, np.ndarray]:
    """(good dictionary, bad dictionary, calibration) from (label, text) rows; ``share`` is
    the share of label 1 among all labels, which the weights restore."""
    if len({y for y, _ in sample}) < 2:
        p = min(max(float(np.mean([y for y, _ in sample])) if sample else 0.5, 0.01), 0.99)
        return b"", b"", np.array([np.log(p / (1 - p)), *[0.0] * 7])
    by_class = {want: [r for r in sample if r[0] == want] for want in (1, 0)}
    xs, ys = [], []
    for half in (0, 1):
        made = Sizes(*(dictionary([t for i, (_, t) in enumerate(rows) if i % 2 == half]) for rows in by_class.values()))
        rest = [r for rows in by_class.values() for i, r in enumerate(rows) if i % 2 != half]
        if rest:
            xs.append(features(np.array([made.of(t) for _, t in rest])))
            ys += [k for k, _ in rest]
    good, bad = (dictionary([t for _, t in rows]) for rows in by_class.values())
    x, y = np.concatenate(xs), np.array(ys, float)
    share = y.mean() if share is None else share
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return good, bad, logistic(x, y, weight, RIDGE)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2,
          threshold: float = THRESHOLD, per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document. Labels of documents whose
    fold is ``held`` are never used."""
    train = fold("doc_id", folds) != held
    sample = labelled_sample(docs, labels, label, train, per_class, fit_bytes)
    rows = sorted(((r["doc_id"], r["y"], bytes(r["text"])) for r in sample.collect()), key=lambda r: r[0])  # bounded, see above
    counts = labels.filter(train).agg(F.avg(F.when(F.col(label).isin(0, 1), F.col(label)))).first()[0]
    good, bad, w = fit([(y, t) for _, y, t in rows], counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Sizes(good, bad)
        for b in batches:
            sizes = np.array([made.of(t) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(features(sizes) @ w, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])],
                ["doc_id", "held_out", "score", "predicted", "good_bytes", "bad_bytes"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), text_bytes().alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, good_bytes long, bad_bytes long")

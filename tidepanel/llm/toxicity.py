"""Counterfactual-regularised toxicity classifier (operator 8).

A logistic model over word and word-stem features of a whole document. Features are chosen by
aggregate counts: those whose document frequency is higher in toxic text beyond chance, and every
form of every identity term. The fit adds a penalty on counterfactuals made from the labelled
sentences: where a sentence mentions an identity term, the same form of each other term of its
family takes the place; where it mentions none, a term picked by the sentence's hash is put in,
against the sentence as it was and against each other term of the family. The squared change of the
logit is penalised, as a mean over all such pairs times the number of labelled rows, so there are
penalty rows for any labelled text, mentions of a group carry no weight of their own, and neutral
mentions are not flagged. ``TERMS`` is the default table of families; any other can be given.

The fit sees a bounded sample, ``PER_CLASS`` labelled rows of each class and texts up to
``FIT_BYTES`` (parameters); scoring reads every whole text once, without a shuffle.

Edge cases: a NULL text is an empty one; empty texts get the base rate; a NULL ``doc_id`` is
scored and not held out; repeated rows are scored each; labels other than 0 and 1 are not learned
from, nor are ids or texts with contradicting ones; equal texts count once in the fit; without labels of both classes every score is the
share of label 1 (0.5 without any, and then nothing is flagged: 0.5 becomes 0.49).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import cut_lineage, fold, text_bytes
from tidepanel.llm.quality_classifier import labelled_sample, logistic

PER_CLASS = 4000
FIT_BYTES = 32_768
MIN_Z = 5.0
MIN_DOCS = 5
RIDGE = 0.005
STEM = 5
PENALTY = 10.0
THRESHOLD = 0.5
# Families of identity terms, each term by its forms (same place, same kind of form).
TERMS: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("woman", "women", "female"), ("man", "men", "male"), ("girl", "girls", "female"), ("boy", "boys", "male")),
    (("christian", "christians", "christianity"), ("muslim", "muslims", "islam"), ("jew", "jews", "judaism"), ("jewish", "jewish", "judaism"),
     ("hindu", "hindus", "hinduism"), ("buddhist", "buddhists", "buddhism"), ("atheist", "atheists", "atheism")),
    (("black", "blacks", "african"), ("white", "whites", "european"), ("asian", "asians", "asian"), ("latino", "latinos", "latino"), ("arab", "arabs", "arab")),
    (("gay", "gays", "homosexual"), ("lesbian", "lesbians", "lesbian"), ("straight", "straights", "heterosexual"), ("bisexual", "bisexuals", "bisexual"),
     ("transgender", "transgender", "trans"), ("queer", "queers", "queer")),
    (("immigrant", "immigrants", "migrant"), ("refugee", "refugees", "refugee"), ("native", "natives", "native"), ("foreigner", "foreigners", "foreign")),
    (("femme", "femmes"), ("homme", "hommes")), (("chrétien", "chrétiens"), ("musulman", "musulmans"), ("juif", "juifs")),
    (("frau", "frauen"), ("mann", "männer")), (("christ", "christen"), ("muslim", "muslime"), ("jude", "juden")),
    (("mujer", "mujeres"), ("hombre", "hombres")), (("cristiano", "cristianos"), ("musulmán", "musulmanes"), ("judío", "judíos")),
)
_SENTENCES = re.compile(rb"[.!?\n]+").split
_WORDS = re.compile(r"[^\W_]+").findall


def words(text: bytes) -> set[str]:
    return set(_WORDS(text.decode("utf-8", "replace").lower()))


def stems(found: set[str], size: int = STEM) -> set[str]:
    """The words and, marked by ``^``, the beginnings of longer ones."""
    return found | {"^" + w[:size] for w in found if len(w) > size}


def counterfactuals(sentence: bytes, families: Sequence = TERMS) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that differ in an identity term only."""
    found, out = words(sentence), []
    if not found or not families:
        return out
    for family in families:
        for term in family:
            for form, word in enumerate(term):
                if word in found:
                    out += [(found, found - {word} | {other[form]}) for other in family if other[form] not in found]
    if not out:
        h = crc32(sentence)
        family = families[h % len(families)]
        term = family[h // len(families) % len(family)]
        form = h // 1009 % len(term)
        made = found | {term[form]}
        out = [(found, made), *((made, found | {other[form]}) for other in family if other[form] != term[form])]
    return out


def all_terms(families: Sequence = TERMS) -> list[str]:
    return sorted({word for family in families for term in family for word in term})


def choose(sample: DataFrame, totals: dict[int, int], min_z: float = MIN_Z, min_docs: int = MIN_DOCS, families: Sequence = TERMS) -> dict[str, float]:
    """Features whose share of documents is higher under label 1 by ``min_z`` standard errors,
    and all forms of the identity terms. The value of a feature is its log odds ratio (at least
    0.5), so strong words need little weight. The sample is bounded, so their number is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ys = [], []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = stems(words(t))
                names += found
                ys += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], ["name", "y"])

    counts = (sample.select(F.col("y").cast("int"), "text").mapInArrow(run, "name string, y int").groupBy("name")
              .agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")))
    n1, n0 = float(totals[1]), float(totals[0])
    share = F.col("n") / (n1 + n0)
    z = (F.col("a") / n1 - (F.col("n") - F.col("a")) / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + F.lit(1e-12))
    counts = cut_lineage(counts.filter(F.col("n") >= min_docs).withColumn("z", z))
    terms = all_terms(families)
    odds = F.greatest(F.lit(0.5), F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n0 + 1)))
    counts = counts.filter((F.col("z") >= min_z) | F.col("name").isin(terms)).select("name", odds.alias("odds"))
    got = dict.fromkeys(terms, 0.5) | {r["name"]: r["odds"] for r in counts.collect()}
    return dict(sorted(got.items()))


def fit(rows: list[tuple[int, bytes]], names: dict[str, float], share: float, pairs: dict[tuple[tuple[str, ...], tuple[str, ...]], int],
        penalty: float = PENALTY) -> np.ndarray:
    """Weights [base, *names]: weighted logistic loss plus the counterfactual penalty. ``pairs``
    counts the counterfactuals by the features that one side has and the other lacks."""
    at = {n: i + 1 for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, (_, t) in enumerate(rows):
        for f in stems(words(t)):
            if f in at:
                x[i, at[f]] = names[f]
    y = np.array([k for k, _ in rows], float)
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    change = np.zeros((len(pairs), len(names) + 1))
    for i, (gone, come) in enumerate(pairs):
        for sign, side in ((-1, gone), (1, come)):
            for f in side:
                change[i, at[f]] += sign * names[f]
    w = logistic(x, y, weight, ridge=RIDGE)
    if not pairs or not penalty:
        return w
    # One more set of rows: the penalty is a quadratic form in the weights, so Newton steps keep their shape.
    many = np.array(list(pairs.values()), float)
    form = penalty * len(rows) / many.sum() * (change.T * many) @ change
    ridge = np.full(len(w), RIDGE * weight.sum() / len(y))
    ridge[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (p - y)) + ridge * w + form @ w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge + 1e-9) + form
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, threshold: float = THRESHOLD,
          per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES, penalty: float = PENALTY, families: Sequence = TERMS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document. Labels of documents whose
    fold is ``held`` are never used."""
    train = fold("doc_id", folds) != held
    sample = labelled_sample(docs, labels, label, train, per_class, fit_bytes)
    sample = cut_lineage(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"), F.max("y").alias("_max")).filter("y = _max").select("doc_id", "y", "text"))
    totals = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    share = labels.filter(train).agg(F.avg(F.when(F.col(label).isin(0, 1), F.col(label)))).first()[0]
    share = min(max(0.49 if share is None else float(share), 0.001), 0.999)
    if len(totals) < 2:
        names, w = {}, np.array([np.log(share / (1 - share))])
    else:
        names = choose(sample, totals, families=families)
        w = fit(_rows(sample, names), names, share, penalty_pairs(sample, names, families), penalty)
    weights = {n: v * x for (n, v), x in zip(names.items(), w[1:].tolist())}
    stem = {n for n in names if n.startswith("^")}
    whole = set(names) - stem
    base = float(w[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = []
            for t in b.column(2).to_pylist():
                found = words(t)
                hit = (whole & found) | (stem & {"^" + w[:STEM] for w in found if len(w) > STEM})
                z.append(base + sum(sorted(map(weights.__getitem__, hit))))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), text_bytes().alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _rows(sample: DataFrame, names: dict[str, float]) -> list[tuple[int, bytes]]:
    """The sample's rows cut down, on Spark, to the words the features need."""
    plain = {n for n in names if not n.startswith("^")}
    stem = {n[1:] for n in names if n.startswith("^")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [" ".join(sorted(w for w in words(t) if w in plain or len(w) > STEM and w[:STEM] in stem)).encode() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary())], ["doc_id", "y", "text"])

    small = sample.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(run, "doc_id long, y int, text binary")
    return [(y, t) for _, y, t in sorted((r[0], r[1], bytes(r[2])) for r in small.collect())]  # 2 * per_class rows at most


def penalty_pairs(sample: DataFrame, names: dict[str, float], families: Sequence = TERMS) -> dict[tuple, int]:
    """Counterfactual pairs of all sentences of the sample, counted by the features in which the
    two sides differ: a few per pair of terms, whatever the number of sentences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0).to_pylist():
                for sentence in _SENTENCES(t):
                    for one, other in counterfactuals(sentence, families):
                        one, other = stems(one) & names.keys(), stems(other) & names.keys()
                        counts[" ".join(sorted(one - other)), " ".join(sorted(other - one))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)] + [pa.array(list(counts.values()), pa.int64())], ["gone", "come", "n"])

    got = sample.select("text").mapInArrow(run, "gone string, come string, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))
    return {(tuple(g.split()), tuple(c.split())): n for g, c, n in sorted(map(tuple, got.collect()))}

"""Quality (1) and toxicity (8): held-out accuracy, edges, counterfactuals."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import quality_classifier as qc, toxicity as tx
from tidepanel.llm.common import table

SF = "/root/testdata/sf0.1"  # some thousand labels: with a few dozen bad ones an accuracy says little


@pytest.mark.parametrize("score,label,folds,held,least", [(qc.score, "quality", 4, 2, 0.93), (tx.score, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, score, label, folds, held, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 for r in rows.values())
    test = [(rows[r.doc_id].predicted, r[label]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([p == y for p, y in test]) >= least
    swapped = labels.withColumn(label, (labels[label] == 0).cast("int")).filter(f"crc32(cast(doc_id as string)) % {folds} = {held}")
    other = labels.filter(f"crc32(cast(doc_id as string)) % {folds} <> {held}").unionByName(swapped)
    assert {r.doc_id: r.score for r in score(docs, other).collect()} == {d: r.score for d, r in rows.items()}  # held-out labels are not used


@pytest.mark.parametrize("score,label", [(qc.score, "quality"), (tx.score, "toxic")])
def test_edges(spark, docs_of, score, label):
    docs = docs_of([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "x " * 50000), (5, "é\n\t")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 1), (2, None, None), (3, 0, 0), (3, 1, 1), (9, 0, 0), (None, 1, 0)], none.schema)
    for labels in (none, some):
        got = score(docs, labels).collect()
        assert len(got) == 7 and all(r.score is not None and 0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert score(docs.limit(0), some).collect() == []


def mentions(spark, seed=2):
    """Toxic texts mention one group much more often than others; held-out texts mention it in peace."""
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(900):
        bad = bool(rng.random() < 0.5)
        words = [f"w{rng.integers(50)}" for _ in range(12)]
        if bad:
            words += ["vile"] * int(rng.random() < 0.7) + ["muslims"] * int(rng.random() < 0.7)
        elif rng.random() < 0.05:
            words.append("muslims")
        docs.append((i, " ".join(rng.permutation(words)) + ". w1 w2"))
        labels.append((i, int(bad)))
    neutral = [(10_000 + i, " ".join([*(f"w{rng.integers(50)}" for _ in range(9)), "muslims"])) for i in range(200)]
    vile = [(20_000 + i, " ".join([*(f"w{rng.integers(50)}" for _ in range(9)), "vile"])) for i in range(100)]
    return spark.createDataFrame(docs + neutral + vile, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neutral_mentions_are_not_flagged(spark):
    """False positives through ``score``, with and without the penalty."""
    docs, labels = mentions(spark)
    flagged = {}
    for penalty in (0.0, tx.PENALTY):
        got = tx.score(docs, labels, penalty=penalty).collect()
        flagged[penalty] = tuple(np.mean([r.predicted for r in got if r.doc_id // 10_000 == part]) for part in (1, 2))
    assert flagged[0.0][0] > 0.9 and flagged[tx.PENALTY][0] < 0.1
    assert flagged[tx.PENALTY][1] > 0.9


def test_penalty_has_rows_for_any_labelled_text(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample = qc.labelled_sample(docs, labels, "toxic", F.lit(True), 300)
    pairs = tx.penalty_pairs(sample, dict.fromkeys(tx.all_terms(), 0.5))
    sentences = [s for r in sample.collect() for s in tx._SENTENCES(bytes(r.text)) if tx.words(s)]
    assert sum(pairs.values()) == sum(len(tx.counterfactuals(s)) for s in sentences) > len(sentences)
    assert all(set(gone) | set(come) <= set(tx.all_terms()) and gone != come for gone, come in pairs)


def test_pairs_differ_in_one_term_only():
    made = tx.counterfactuals(b"Two women and a jew walk")
    assert {(tuple(a - b), tuple(b - a)) for a, b in made} == {
        *((("women",), (x,)) for x in ("men", "girls", "boys")), *((("jew",), (x,)) for x in ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"))}
    put = tx.counterfactuals(b"plain words here")
    assert not put[0][0] - put[0][1] and len(put[0][1] - put[0][0]) == 1 and all(len(a ^ b) == 2 for a, b in put[1:])
    assert tx.counterfactuals(b"") == [] == tx.counterfactuals(b"words", ())


def test_fit_is_the_least_loss():
    """The weights against plain descent on the same loss."""
    rng = np.random.default_rng(4)
    names = {"jews": 0.5, "muslims": 1.5, "vile": 2.0}
    rows = [(int(rng.random() < 0.5), " ".join(n for n in names if rng.random() < 0.5).encode()) for _ in range(60)]
    pairs = {(("jews",), ("muslims",)): 7, ((), ("muslims",)): 3}
    w = tx.fit(rows, names, 0.3, pairs, 2.0)
    x = np.array([[1, *(names[n] * (n in t.decode().split()) for n in names)] for _, t in rows])
    y = np.array([k for k, _ in rows])
    weight = np.where(y > 0, 0.3 / y.mean(), 0.7 / (1 - y.mean()))
    d = np.array([[0, -0.5, 1.5, 0], [0, 0, 1.5, 0]])
    pen = np.full(4, tx.RIDGE * weight.sum() / 60)
    pen[0] = 1e-9

    def loss(v):
        z = x @ v
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (pen * v * v).sum() / 2 + 2.0 * 60 / 10 * ((d @ v) ** 2 * [7, 3]).sum() / 2

    best = loss(w)
    assert all(loss(w + step) >= best - 1e-9 for step in 1e-3 * rng.normal(size=(300, 4)))


def test_sample_is_settled_by_order(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "same"), (3, "same")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: bytes(r.text) for r in qc.labelled_sample(docs, labels, "toxic", F.lit(True)).collect()}
    assert got == {1: b"a", 2: b"same", 3: b"same"}
    first, again = (sorted(map(tuple, tx.score(d, labels).collect())) for d in (docs, docs.orderBy(F.desc("text"))))
    assert first == again

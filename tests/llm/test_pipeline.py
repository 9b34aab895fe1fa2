"""The pipeline stage by stage against brute force on each stage's own input."""

from collections import Counter

import corpus_pipeline as cp
from tests.llm.conftest import SF
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_mixing import fill
from tests.llm.test_packing import check
from tests.llm.test_quality_rules import brute as counts
from tidepanel.llm import packing
from tidepanel.llm.common import cut_lineage


def test_stages(spark, documents):
    docs, names = documents, [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "language_id", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    made = []
    for _, stage in cp.STAGES:
        made.append(docs)
        docs = cut_lineage(stage(spark, docs, SF))
        assert len(made) == len(cp.STAGES) or docs.columns == documents.columns
    made.append(docs)
    rows = [[tuple(r) for r in d.collect()] for d in made]
    for r in rows[0]:
        n, _, _, _, again = counts(r[1])
        if n < 10 or 100 * again > 20 * n:
            assert r not in rows[1]
    assert set(rows[1]) <= set(rows[0]) and set(rows[2]) <= set(rows[1]) and len(rows[2]) >= 0.97 * len(rows[1])
    named = components([(r[0], r[1]) for r in rows[2]])
    assert sorted(r[0] for r in rows[3]) == sorted({int(c) for _, _, c in named})
    times = Counter(rows[4])
    size, got = Counter(), Counter()
    for r in rows[3]:
        size[r[3]] += len(r[1].split())
        got[r[3]] += len(r[1].split()) * times[r]
        assert times[r] <= 3
    want = fill(size)
    assert all(abs(got[s] - want[s]) <= 2 * max(len(r[1].split()) for r in rows[3] if r[3] == s) for s in size)
    packed = made[5].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter({d[0]: n for d, n in times.items()})
    seen, one = set(), []
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece, r.sequence_id, r.offset)):
        if (r.doc_id, r.piece) not in seen:
            seen.add((r.doc_id, r.piece))
            one.append(r)
    assert all(r.offset + r.length <= packing.SIZE for r in packed)
    assert len(times) == len({r.doc_id for r in one})


def test_run_is_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_clashing_columns_nulls_and_empty_tables(docs_of):
    text = " ".join(f"word{i} and" for i in range(30))
    docs = docs_of([(1, text), (2, text), (3, None), (None, text + " more"), (4, "ab " * 500), (5, text.upper())]).withColumnRenamed("y", "row").withColumnRenamed("unit", "_n")
    spark = docs.sparkSession
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in cp.STAGES[:-1]:
            out = cut_lineage(stage(spark, out, SF))
            assert out.columns == docs.columns
        assert (cp.STAGES[-1][1](spark, out, SF).count() > 0) == (start is docs)


def test_packing_checks_the_right_texts(documents):
    check(packing.pack(documents.limit(30), cp.tokenizer_path()).collect(), {r.doc_id: r.text for r in documents.limit(30).collect()}, packing.SIZE)


def test_helper_names_do_not_clash(spark):
    """Rows with every name the stages use inside, repeated ids and rows that differ elsewhere only."""
    from tidepanel.llm import jaccard_join, mixing

    text = " ".join(f"w{i}" for i in range(40))
    names = ("_unit", "_take", "_nth", "_again", "unit", "copies", "rows", "row", "id", "words", "nth", "again")
    rows = [(1, text, "s", *"a" * len(names)), (1, text, "s", *"b" * len(names)), (2, text, "s", *"c" * len(names)), (3, "other words", None, *"d" * len(names)),
            (None, "no id", "t", *"e" * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for made in (mixing.take(docs, most=1.0), jaccard_join.one_of_each(docs)):
        assert made.columns == docs.columns
        got = made.collect()
        assert {tuple(r) for r in got} <= set(rows)
        first = [tuple(r) for r in got if r.doc_id == 1]
        assert first and set(first) == {rows[0]}
    assert sorted(r._unit for r in jaccard_join.one_of_each(docs).collect()) == ["a", "d", "e"]

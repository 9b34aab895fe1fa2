"""Many short texts that nearly link, in the n-gram Jaccard join (9)."""

import pyarrow as pa

from tidepanel.llm import jaccard_join as jj

N, TWINS = 20_000, 200
FIXED = "all these nine words are the same each time"


def templated(spark):
    """One own word and nine fixed ones: 5 of 7 n-grams shared. Some have a twin with one more word."""
    rows = [(i, f"own{i} {FIXED}") for i in range(N)] + [(N + i, f"own{i * 97} {FIXED} end") for i in range(TWINS)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_groups_are_bounded_by_sets(spark, monkeypatch):
    """No task is given more than two chunks of sets."""
    monkeypatch.setattr(jj, "_compare", lambda percent: lambda t: pa.table({"a": pa.array([t.num_rows], pa.int64()), "b": pa.array([0], pa.int64())}))
    sizes = []
    rest = jj._rest

    def spy(*args):
        sizes.extend(r.a for r in rest(*args).collect())
        return rest(*args).limit(0)

    monkeypatch.setattr(jj, "_rest", spy)
    jj.join_documents(templated(spark))
    assert sizes and max(sizes) < 2 * 2_000 * 1.2 and sum(sizes) >= N


def test_only_twins_link(spark):
    got = {r.doc_id: r.component_id for r in jj.join_documents(templated(spark)).collect()}
    assert got == {i: i for i in range(N)} | {N + i: i * 97 for i in range(TWINS)}

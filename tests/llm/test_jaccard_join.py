import random
import re

import numpy as np
import pytest

from tidepanel.llm import jaccard_join as jj
from tidepanel.llm.components import components
from tests.llm.conftest import WORDS


def brute(rows, percent=80):
    """doc_id (by row number) -> (n, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def fixture(seed, docs=160):
    """Unrelated texts, copies, near copies with edits around the threshold, shared passages,
    short texts."""
    rng = random.Random(seed)
    out, new = [], lambda n: [rng.choice(WORDS) for _ in range(n)]
    passage, template = new(60), new(120)
    for i in range(docs):
        kind = rng.random()
        if kind < 0.15:
            w = new(rng.randint(1, 9))
        elif kind < 0.3:
            w = new(rng.randint(5, 40)) + passage
        elif kind < 0.6:
            w = template.copy()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        elif kind < 0.9 and out:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
            w = w[:rng.randint(max(len(w) - 8, 0), len(w))]
        else:
            w = new(rng.randint(10, 200))
        out.append((i, " ".join(w)))
    rng.shuffle(out)
    return [(1000 - d, t) for d, t in out] + [(2000, None), (2001, ""), (2002, "  \n")]


@pytest.mark.parametrize("seed,rounds,bound", [(1, 2, None), (2, 0, None), (3, 1, 0), (4, 0, 10 ** 6)])
def test_against_all_pairs(docs_of, monkeypatch, seed, rounds, bound):
    rows = fixture(seed)
    real = jj.join_sets
    monkeypatch.setattr(jj, "join_sets", lambda s, p, percent, chunk_keys: real(s, p, percent, rounds, chunk_keys))
    if bound is not None:
        monkeypatch.setattr(jj, "boundary", lambda sets, percent: min(bound, 60))
    got = jj.join_documents(docs_of(rows).repartition(3), block_bytes=4000, range_bytes=6000, chunk_keys=600).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_edges(docs_of):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(30000))
    rows = [(5, "A b C"), (4, "a B c"), (7, "a b c d"), (None, long), (9, long + " end"), (8, long), (6, "x"), (6, "x"), (3, None), (3, "other words in here now"), (None, "q r s")]
    got = jj.join_documents(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert jj.join_documents(docs_of(rows).limit(0)).collect() == []
    left = jj.one_of_each(docs_of(rows))
    ids = [r.doc_id for r in left.collect()]
    assert 9 not in ids and 5 not in ids and ids.count(6) == 1 and ids.count(3) == 2


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {(v, find(v)) for v in list(root) if find(v) != v}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_deltas_round_trip():
    for v in ([5], [0, 0, 1], [1, 2 ** 47, 2 ** 48 - 1]):
        assert jj._undeltas(jj._deltas(np.array(v, np.uint64))).tolist() == v

import random
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import mixing


def fill(sizes):
    """Targets by resharing the excess over and over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, cap, open_ = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, set(order)
    while True:
        rest = total - sum(cap[s] for s in order if s not in open_)
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > cap[s] + 1e-9}
        if not over:
            return {s: rest * weight[s] / w if s in open_ else cap[s] for s in order}
        open_ -= over


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(3000):
        s = rng.choice(["a", "a", "a", "a", "b", "b", "c", "Z", "é", None, "tiny"] if i % 9 else ["a"])
        n = min(int(rng.paretovariate(1.1) * 10), 4000)
        out.append((i, " ".join("x" * (1 + k % 3) for k in range(n)), s))
    out += [(3001, None, "b"), (3002, "", "empty"), (None, "one two", "b"), (3, out[3][1], out[3][2])]
    return out


def test_targets_balance_and_reruns(docs_of, rows):
    docs = docs_of(rows)
    got = mixing.mix(docs, block=200, fan=4).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3 and (r["size"] or not r.copies)
    want = fill(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        biggest = max(r["size"] for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 2 * biggest
    big = [s for s in size if sum(r.source == s for r in got) > 200]
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in big)
    again = mixing.mix(docs.repartition(7), block=200, fan=4).collect()
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.copies) for r in rs)
    assert key(got) == key(again)
    takes = mixing.take(docs, block=200, fan=4)
    assert takes.columns == docs.columns and takes.count() == sum(r.copies for r in got)


def test_empty_and_wordless(docs_of):
    assert mixing.mix(docs_of([(1, "a")]).limit(0)).collect() == []
    assert [(r.target, r.copies) for r in mixing.mix(docs_of([(1, ""), (2, None)])).collect()] == [(0.0, 0)] * 2


@pytest.mark.parametrize("seed", range(20))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    size, p = rng.integers(1, [2, 50, 5000][seed % 3], n), rng.random(n)
    x = mixing.flight(size, p, rng)
    assert ((x > 0) & (x < 1)).sum() <= 2
    assert x.sum() == pytest.approx(p.sum(), abs=1e-6) and (x * size).sum() == pytest.approx((p * size).sum(), rel=1e-6, abs=1e-4)


def test_flight_keeps_probabilities():
    size, p = np.array([3, 5, 9, 4, 7, 2]), np.array([0.3, 0.5, 0.7, 0.2, 0.4, 0.9])
    mean = np.mean([mixing.flight(size, p, np.random.default_rng(s)) for s in range(4000)], 0)
    assert np.abs(mean - p).max() < 0.04

import math

import numpy as np
import pytest

from tidepanel.llm import exact_topk


def brute(rows, queries, k, scale):
    ok = {i: [math.floor(scale * float(np.float32(x))) for x in v] for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ok:
            s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(2048, 1024), (16, 8)])
def test_against_brute_force(spark, block, query_block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 12)) * rng.pareto(1.5, (300, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(400 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, [1.0] * 12), (504, [1.0, 2.0]), (505, []), (506, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS rank", "3 AS score")
    queries = df.filter("vec_id % 10 = 0 or vec_id > 500")
    got = exact_topk.top_k(df, queries, block=block, query_block=query_block, rows_per_task=100)
    ids = [i for i, _ in rows if i is not None and (i % 10 == 0 or i > 500)]
    assert sorted(map(tuple, got.collect())) == brute(rows, ids, 5, 256)


def test_few_candidates_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 1.0]), (50, [0.5, 0.5])], kind)
    got = exact_topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()
    assert len(got) == 4
    assert exact_topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_bounds_prune_but_lose_nothing():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 20)) * 50 * rng.pareto(2, (500, 1))).astype(np.int64)
    order = np.argsort(-(x * x).sum(1))
    x = x[order]
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    pack = lambda i: (i.astype(np.int64), x[i], x[i] @ turn, np.sqrt((x[i] ** 2).sum(1)))
    q = np.arange(0, 500, 25)
    best = exact_topk.search_pair(pack(q), pack(np.arange(500)), np.full(len(q), -np.inf), 5, head=4, step=32)
    for j, i in enumerate(q):
        want = sorted((-int(x[i] @ x[c]), int(c)) for c in range(500) if c != i)[:5]
        assert sorted((-int(s), int(c)) for s, c in zip(best.score[best.q == j], best.id[best.q == j])) == want

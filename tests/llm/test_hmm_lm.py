import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import hmm_lm
from tidepanel.llm.blobs import squeeze, unsqueeze
from tidepanel.llm.common import table


def model(k=3, c=6, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.random((c + 1, k))
    moves = rng.random((k, k))
    start = rng.random(k)
    return hmm_lm.Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def paths(m, seq):
    """Probability of every state path."""
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        v = m.start[p[0]] * m.emit[seq[0], p[0]]
        for a, b, x in zip(p, p[1:], seq[1:]):
            v *= m.moves[a, b] * m.emit[x, b]
        yield p, v


def test_forward_and_counts_against_all_paths():
    m = model()
    seqs = [[0, 3, 5, 6], [6], [2, 2, 1, 4, 0, 6], [5, 6]]
    codes = np.concatenate([np.array(s) for s in seqs])
    lengths = np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    want, sums = [], [np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))]
    for s in seqs:
        total = sum(v for _, v in paths(m, s))
        want.append(math.log(total))
        for p, v in paths(m, s):
            sums[0][p[0]] += v / total
            for a, b in zip(p, p[1:]):
                sums[1][a, b] += v / total
            for x, a in zip(s, p):
                sums[2][x, a] += v / total
    assert hmm_lm.forward(m, codes, starts, lengths) == pytest.approx(want)
    got = hmm_lm.fresh(m)
    assert hmm_lm.expected(m, codes, starts, lengths, got) == pytest.approx(sum(want))
    assert np.allclose(got[0], sums[0]) and np.allclose(got[1] * m.moves, sums[1]) and np.allclose(got[2], sums[2])


def test_byte_planes_round_trip():
    for v in ([], [0], [1, 255, 256, 70000, 2 ** 32 - 1]):
        assert unsqueeze(squeeze(np.array(v, np.uint32))).tolist() == v


def base(rows):
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = {i: [*(t or "").encode().lower().split(), None] for i, (d, t) in enumerate(rows)}
    c = Counter(w for i, (d, t) in enumerate(rows) if not out(d) for w in words[i])
    n, v = sum(c.values()), len(c)
    return [(d, out(d), len(words[i]), sum(c[w] > 0 for w in words[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]))
            for i, (d, t) in enumerate(rows)]


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(([r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score] for r in got), key=key)
    for g, w in zip(got, sorted(base(rows), key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_edges_and_small_blocks(docs_of, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the of And a B c dé q%d" % rng.randint(0, 99)).strip() or "x" for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "the of"), (3, rows[3][1]), (202, "w " * 5000)]
    monkeypatch.setattr(hmm_lm, "RANGE_BYTES", 2000)
    got = hmm_lm.score(docs_of(rows), block_bytes=3000, classes=64, states=3).collect()
    check(got, rows)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert hmm_lm.score(docs_of(rows).limit(0)).collect() == []
    alone = hmm_lm.score(docs_of([(d, "a b") for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2])).collect()
    assert {r.base_score for r in alone} == {0.0} and {r.n_known for r in alone} == {0}


def test_table_beats_the_base_on_held_out_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = hmm_lm.score(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_score_is_the_models_probability(docs_of, monkeypatch):
    """The column ``score`` of every document from the returned model, path sums in plain loops."""
    import math
    import random
    from collections import Counter
    from zlib import crc32

    from xxhash import xxh64_intdigest

    rng = random.Random(3)
    texts = {i: " ".join(rng.choice("the a cat Dog sat ran on mat hat".split()) for _ in range(rng.randint(0, 25))) for i in range(60)}
    kept = {}
    original = hmm_lm.train

    def train(*args):
        kept["m"], kept["found"] = original(*args)
        return kept["m"], kept["found"]

    monkeypatch.setattr(hmm_lm, "train", train)
    got = {r.doc_id: r for r in hmm_lm.score(docs_of(list(texts.items())), states=2, classes=5).collect()}
    m, counts = kept["m"], Counter()
    for doc, text in texts.items():
        if crc32(str(doc).encode()) % 7 != 2:
            counts.update(text.lower().split())
    cls = lambda w: xxh64_intdigest(w.encode()) % 5
    vocabulary = {w for t in texts.values() for w in t.lower().split()}
    inside = [sum(counts[w] for w in counts if cls(w) == c) + sum(cls(w) == c for w in counts if counts[w]) + 1 for c in range(5)]
    assert vocabulary and len(kept["found"]) >= 2 and all(b > a - 1e-6 for a, b in zip(kept["found"], kept["found"][1:]))
    for doc, text in texts.items():
        words = text.lower().split()
        codes = [*map(cls, words), 5]
        a = [m.start[s] * m.emit[codes[0]][s] for s in range(2)]
        for c in codes[1:]:
            a = [sum(a[i] * m.moves[i][j] for i in range(2)) * m.emit[c][j] for j in range(2)]
        want = math.log10(sum(a)) + sum(math.log10((counts[w] + 1) / inside[cls(w)]) for w in words)
        assert abs(got[doc].score - want) < 1e-6 * max(1, abs(want))

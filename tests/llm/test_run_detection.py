import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tests.llm.conftest import SF
from tidepanel.llm import run_detection
from tidepanel.llm.queries import QUERIES

SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def brute(words, least=24, times=3):
    """Every longest stretch per period, kept if no smaller period holds on it."""
    out = []
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(words[t] == words[t + d] for t in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("seed", range(150))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(rng.randint(1, 4)):
        words = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            block = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
            words += (block * 12)[:rng.randint(1, 60)] + [rng.randint(0, 2) for _ in range(rng.randint(0, 5))]
        docs.append(words)
    least, times = rng.choice([(24, 3), (4, 3), (6, 2)])
    flat = np.array([d << 32 | w for d, words in enumerate(docs) for w in words], np.int64)
    at, want = 0, []
    for words in docs:
        want += [(s + at, n, q) for s, n, q in brute(words, least, times)]
        at += len(words)
    assert [tuple(r) for r in run_detection.runs(flat, least, times).tolist()] == want


def rewritten(doc, text):
    words = [w for w in (text or "").translate(SPACES).split(" ") if w]
    h = crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def fast(words):
    """Brute force for longer texts: smaller periods are told by the runs already found."""
    w = np.array([hash(x) for x in words], np.int64)
    out = []
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(np.diff(same.astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = e - s + q
            if n >= max(24, 3 * q) and not any(a <= s and s + n <= a + m and d < q for a, m, d in out):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_against_brute_force(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for doc, text in rows:
        words = rewritten(doc, text)
        found = fast(words)
        r = got[doc]
        some += bool(found)
        assert r.n_runs == len(found)
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed(words, found).encode()).hexdigest()
        if found:
            from fractions import Fraction
            s, n, q = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some > 5


def test_edges(docs_of):
    texts = {1: None, 2: "", 3: " \t\n ", 4: "a " * 23, 5: "a " * 24, 6: "a " * 24, 7: "x " + "a b c " * 9 + "a y", 8: "a a " * 12, 9: "z " * 30_000}
    got = {r.doc_id: r for r in run_detection.find(docs_of(list(texts.items()))).collect()}
    assert all(got[i].runs == [] for i in (1, 2, 3, 4, 8))
    assert got[1].collapsed == got[2].collapsed == got[3].collapsed == "" and got[4].n_words == 23
    assert [tuple(r) for r in got[5].runs] == [(0, 24, 1)] == [tuple(r) for r in got[6].runs]
    assert [tuple(r) for r in got[7].runs] == [(1, 28, 3)] and got[7].collapsed == "x a b c y"
    assert [tuple(r) for r in got[9].runs] == [(0, 30_000, 1)] and got[9].collapsed == "z"
    assert run_detection.find(docs_of([(None, "a"), (9, "b"), (9, "b")])).count() == 3
    assert run_detection.find(docs_of([(1, "a")]).limit(0)).collect() == []


def test_strongest_breaks_ties_by_start_then_period(spark):
    made = spark.createDataFrame([(1, [(5, 30, 10), (2, 27, 9), (40, 24, 8)]), (2, [(7, 60, 20), (7, 30, 10)]), (3, [])],
                                 "doc_id long, runs array<struct<start: long, length: long, period: long>>")
    got = {r.doc_id: r.best for r in made.select("doc_id", run_detection.strongest().alias("best")).collect()}
    assert tuple(got[1]) == (2, 27, 9) and tuple(got[2]) == (7, 30, 10) and got[3] is None

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepanel.llm import automaton, collocations


def brute(rows, least, within, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= within * a for q, b in found.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "ß", "x y", "e", "\U0001f600", "the"]
    out = [(None, "en"), ("", None), ("...,,\n", "en")]
    for i in range(120):
        words = [rng.choice(vocabulary[:rng.randint(2, 9)]) for _ in range(rng.randint(0, 60))]
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for w in words), rng.choice(["en", "en", "en", None, "und", "a\tb", "d\ne"])))
    return out + [("hot pair " * 800, "en")] * 3


@pytest.mark.parametrize("seed,range_bytes,fan", [(1, 1 << 20, 256), (2, 600, 256), (3, 600, 3), (4, 300, 2)])
def test_against_brute_force(docs_of, seed, range_bytes, fan):
    """One range, many ranges, and several levels of them."""
    rows = made(seed)
    docs = docs_of([(i, t, "src", lang) for i, (t, lang) in enumerate(rows)]).repartition(7)
    got = collocations.mine(docs, least=4, top=40, range_bytes=range_bytes, block_bytes=2000, fan=fan)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == brute(rows, 4, 50, 40)


def test_united_groups_stay_as_small_as_a_range(docs_of, monkeypatch):
    """With a few more ranges than parts per block, a task of the first level holds no large share of the text."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    docs = docs_of([(i, " ".join(rng.choices(words, k=100))) for i in range(200)]).repartition(4)
    seen = []

    def kept(df, *keys):
        seen.append((df, keys))
        return df

    monkeypatch.setattr(collocations, "spread", kept)
    collocations.mine(docs, range_bytes=2200, block_bytes=2200, fan=32)
    size = Counter()
    for r in next(df for df, keys in seen if keys == ("rng", "block")).select("rng", "block", "blob").collect():
        size[r["rng"], r["block"]] += int(automaton.load(bytes(r["blob"]))[5].sum())
    assert sum(size.values()) == 200 * 100
    assert max(size.values()) <= 5 * 200 * 100 / 40  # about forty ranges


def test_counts_beyond_64_bits_in_products(spark, docs_of, monkeypatch):
    """Scores multiply three large counts."""
    heads, words = [b"en\ta", b"en\tb"], [b"", b"b"]
    big = 3 * 10 ** 12
    blob = automaton.Paths(heads, words, np.array([0, 1]), np.array([1, 0]), np.array([0, 0]), np.array([big, big + 1])).dump()
    reply = [(0, 0, automaton.pack([np.array([big, big + 1])])), (0, None, automaton.pack([np.zeros(2, np.int64)]))]

    class Held:
        value = []

    import pyarrow as pa
    out = collocations._score(10, 50, 5, Held, (0,), pa.table({"rng": pa.array([0], pa.int32()), "blob": [blob]}),
                              pa.table({"rng": pa.array([0, 0], pa.int32()), "src": pa.array([r[1] for r in reply], pa.int32()), "blob": [r[2] for r in reply]}))
    assert out.to_pylist()[0] | {"rng": 0} == {"lang": "en", "phrase": "a b", "a": big, "l": big, "r": big + 1, "score": 10 ** 6 * big // (big + 1), "rng": 0, "n": None}


def test_empty_and_rare(docs_of):
    assert collocations.mine(docs_of([(1, "a")]).limit(0)).collect() == []
    assert collocations.mine(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b")])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_automata_keep_their_paths(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    heads, words = [b"h%03d" % i for i in range(9)], [b"", *(b"w%03d" % i for i in range(12))]
    columns = [rng.integers(0, k, n) for k in (9, 13, 13)]
    weight = rng.integers(1, 2 ** 40, n)
    want = Counter()
    for *path, w in zip(*(c.tolist() for c in columns), weight.tolist()):
        want[tuple(path)] += w

    def spelled(blobs):
        p = automaton.union(blobs)
        return {(p.heads[a], p.words[b], p.words[c]): w for a, b, c, w in zip(*(x.tolist() for x in (p.head, p.second, p.third, p.weight)))}

    def named(paths):
        return {(heads[a], words[b], words[c]): w for (a, b, c), w in paths.items()}

    p = automaton.Paths(heads, words, *columns, weight)
    assert spelled([p.dump()]) == named(want)
    assert spelled([p.dump(), p.dump()]) == named({k: 2 * w for k, w in want.items()})
    bounds = sorted({(b"h003", b""), (b"h003", b"w005"), (b"h0035", b"w001"), (b"h008", b"z"), (b"zz", b"")})
    edges = p.cut(bounds)
    parts = [p.dump(a, b) for a, b in zip(edges, edges[1:]) if b > a]
    assert spelled(parts) == named(want)
    lows = [(b"", b""), *bounds]
    for low, high, a, b in zip(lows, [*bounds, (b"zzz", b"")], edges, edges[1:]):
        assert all(low <= (heads[p.head[i]], words[p.second[i]]) < high for i in range(a, b))


def test_equal_continuations_are_stored_once():
    """1,000 first words with the same continuations make one state of each kind."""
    heads, words = [b"%04d" % i for i in range(1000)], [b"", b"x", b"y"]
    p = automaton.Paths(heads, words, np.repeat(np.arange(1000), 2), np.tile([1, 1], 1000), np.tile([1, 2], 1000), np.ones(2000, np.int64))
    state, many, *_ = automaton.unpack(p.dump(), (0, 1))[2:]
    assert len(state) == 1000 and set(state.tolist()) == {0} and many.tolist() == [1]

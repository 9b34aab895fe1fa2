"""Weighted acyclic automata over word paths: counts of n-grams as arrays and as blobs.

A path is ``(head, second, third)``; an empty second or third label says that the piece of
text ended. ``Paths`` holds sorted distinct paths with their weights; sums over a prefix are
sums over neighbours. ``dump`` builds the minimal automaton of a stretch of paths: prefixes
close in sorted order, a closed state is looked up in a register of states with the same arcs
and weights, so equal continuations are stored once. ``load`` spells the paths out again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import zstandard


def pack(fields: list[np.ndarray | list[bytes]]) -> bytes:
    """Whole numbers as byte planes of the width they need, strings as lengths and bytes."""
    out = []
    for f in fields:
        text = b""
        if isinstance(f, list):
            text, f = b"".join(f), np.fromiter(map(len, f), np.int64, len(f))
        wide = max(1, (int(f.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(f, "<i8").view(np.uint8).reshape(-1, 8)[:, :wide].T
        out += [np.array([len(f), wide, len(text)], "<i8").tobytes(), planes.tobytes(), text]
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(b"".join(out))


def unpack(blob: bytes, strings: Iterable[int]) -> list:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n, wide, text = np.frombuffer(data, "<i8", 3, at).tolist()
        at += 24
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :wide] = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n).T
        f = planes.reshape(-1).view("<i8")
        at += n * wide
        if len(out) in strings:
            ends = (np.cumsum(f) + at).tolist()
            f = [data[a:b] for a, b in zip([at, *ends], ends)]
            at += text
        out.append(f)
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spell(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices first[i] .. first[i] + n[i] - 1, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _register(starts: np.ndarray, label: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of the groups of arcs: the state of each group, and per state its number of arcs
    and their labels and targets."""
    arcs = np.stack([label, to], 1).astype("<i8").tobytes()
    edges = (np.append(starts, len(label)) * 16).tolist()
    register: dict[bytes, int] = {}
    state = [register.setdefault(arcs[a:b], len(register)) for a, b in zip(edges, edges[1:])]
    flat = np.frombuffer(b"".join(register), "<i8").reshape(-1, 2)
    return np.array(state, np.int64), np.fromiter(map(len, register), np.int64, len(register)) // 16, flat[:, 0], flat[:, 1]


class Paths:
    """Sorted distinct paths: ``head``, ``second`` and ``third`` number sorted labels; the words
    start with the empty one."""

    def __init__(self, heads: list[bytes], words: list[bytes], head: np.ndarray, second: np.ndarray, third: np.ndarray, weight: np.ndarray | None = None):
        self.heads, self.words = heads, words
        a, b = max(1, len(heads) - 1).bit_length(), max(1, len(words) - 1).bit_length()
        if a + 2 * b < 64:
            key = head << 2 * b | second << b | third
            if weight is None:
                key.sort()
            else:
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
            head, second, third = key >> 2 * b, key >> b & (1 << b) - 1, key & (1 << b) - 1
            first = _starts(key)
        else:
            order = np.lexsort((third, second, head))
            head, second, third = head[order], second[order], third[order]
            weight = None if weight is None else weight[order]
            first = _starts(head, second, third)
        self.weight = np.diff(np.append(first, len(head))) if weight is None else np.add.reduceat(weight, first) if len(first) else weight
        self.head, self.second, self.third = head[first], second[first], third[first]

    def starts(self, depth: int) -> np.ndarray:
        return _starts(*(self.head, self.second)[:depth])

    def cut(self, bounds: list[tuple[bytes, bytes]]) -> list[int]:
        """Positions where the ranges between ``bounds`` of (head, second) start, and the end."""
        key, wide = self.head * len(self.words) + self.second, len(self.words)
        at = []
        for head, word in bounds:
            i = bisect_left(self.heads, head)
            j = bisect_left(self.words, word) if i < len(self.heads) and self.heads[i] == head else 0
            at.append(i * wide + j)  # j may be one behind the last word: the next head
        return [0, *np.searchsorted(key, np.array(at, np.int64)).tolist(), len(key)]

    def dump(self, a: int = 0, b: int | None = None) -> bytes:
        """The minimal automaton of the paths a .. b - 1."""
        head, second, third, weight = (x[a:b] for x in (self.head, self.second, self.third, self.weight))
        used, head = np.unique(head, return_inverse=True)
        words = np.union1d(np.union1d(second, third), [0])
        second, third = np.searchsorted(words, second), np.searchsorted(words, third)
        first = _starts(head, second)
        state, *last = _register(first, third, weight)
        head, second = head[first], second[first]
        state, *middle = _register(_starts(head), second, state)
        return pack([[self.heads[i] for i in used.tolist()], [self.words[i] for i in words.tolist()], state, *middle, *last])


def load(blob: bytes) -> tuple:
    """Labels and paths of an automaton: heads, words, head, second, third, weight."""
    heads, words, state, many, second, to, many2, third, weight = unpack(blob, (0, 1))
    first, first2 = np.cumsum(many) - many, np.cumsum(many2) - many2
    arcs = _spell(first[state], many[state])
    head, second, to = np.repeat(np.arange(len(state)), many[state]), second[arcs], to[arcs]
    arcs = _spell(first2[to], many2[to])
    n = many2[to]
    return heads, words, np.repeat(head, n), np.repeat(second, n), third[arcs], weight[arcs]


def union(blobs: list[bytes]) -> Paths:
    """One set of paths with the sums of the weights."""
    parts = [load(b) for b in blobs]
    heads, words = (sorted({x for p in parts for x in p[i]}) for i in (0, 1))
    columns = [[], [], [], []]
    at_head, at_word = {x: i for i, x in enumerate(heads)}, {x: i for i, x in enumerate(words)}
    for h, w, head, second, third, weight in parts:
        h = np.fromiter(map(at_head.__getitem__, h), np.int64, len(h))
        w = np.fromiter(map(at_word.__getitem__, w), np.int64, len(w))
        for c, x in zip(columns, (h[head], w[second], w[third], weight)):
            c.append(x)
    return Paths(heads, words, *map(np.concatenate, columns))

"""Phrase collocations by weighted acyclic automata (operator 12).

Every word of a text starts one path ``(lang and word, next word, word after that)``, with
empty labels where its piece of text ends, so the count of a phrase of one to three words is
the sum over the paths it begins. Blocks of documents build count transducers from their
sorted paths (see ``automaton``), cut at bounds of prefixes (lang, word, word); the parts of a
prefix range are united with sums of weights. Bounds come from the words of a bounded sample
(``SAMPLE_DOCS`` documents) and only balance the ranges; a very frequent first word spreads
over many of them. A block sends ``FAN`` parts at most: with more ranges than that, coarse
ranges are united in groups first and cut again, so rows exchanged grow with the text. A coarse
range of s ranges is united in s groups of blocks, so that a task of any level holds about as
much text as a range has.

Lookups of a candidate's parts are a composition: a range sends the sorted phrases it needs to
the ranges that hold them, there they run through the count transducer, and the counts come
back. A word whose paths lie in several ranges is asked for in all of them and summed. The
same walk tells a range the most frequent three-word candidate that ends with each of its
two-word phrases, the ones that begin with it lie in the range itself; so containment needs no
join either. Scores are whole-number arithmetic of any size.

Each range keeps its best ``top`` phrases per language, exactly; a window ranks what is left.

Edge cases: NULL texts are empty; NULL languages are ``und``; other columns, NULL or repeated
ids play no part (every row counts); very long texts are read whole; a language without
candidates gives no rows; an empty table gives no rows. Ranges hold about ``RANGE_BYTES`` of
text; there are ``MOST_RANGES`` at most, beyond which (500 GB of text) they grow.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm import automaton
from tidepanel.llm.common import by_bytes, cut_lineage, join_checked, rows_of, text_bytes, text_total
from tidepanel.plans.session import discard, spread

LEAST = 10
WITHIN = 50
TOP = 2000
SCALE = 1_000_000
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
MOST_RANGES = 65_536
FAN = 256
SAMPLE_DOCS = 2000
SAMPLE_KEYS = 20_000
SPLIT = 64

STOP = b"\xff"  # no byte of UTF-8
_TABLE = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words with ``STOP`` between pieces."""
    return text.translate(_TABLE).replace(STOP, b" \xff ").split()


def _labelled(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"), text_bytes(text).alias("text"))


def _bounds(docs: DataFrame, ranges: int, rows: int, size: int) -> list[tuple[bytes, bytes]]:
    """Prefixes (lang and word, word) that part the sampled words about evenly."""
    share = min(1.0, SAMPLE_DOCS / max(rows, 1))
    stride = max(1, int(share * size / 6 / max(SAMPLE_KEYS, 8 * ranges)))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for lang, text in rows_of(b):
                words = [*tokens(text), STOP]
                keys += [(lang + b"\t" + words[i], b"" if words[i + 1] == STOP else words[i + 1])
                         for i in range(len(text) % stride, len(words) - 1, stride) if words[i] != STOP]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.binary()) for i in (0, 1)], ["head", "word"])

    got = sorted(tuple(map(bytes, r)) for r in docs.filter(F.rand(7) < share).mapInArrow(pick, "head binary, word binary").collect())
    return sorted({got[len(got) * i // ranges] for i in range(1, ranges)}) if got else []


def _paths(langs: list[bytes], texts: list[list[bytes]], number: defaultdict) -> automaton.Paths:
    flat = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int64)
    lang = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    named = sorted(set(langs))
    lang = np.array([bisect_left(named, x) for x in langs], np.int64)[lang]
    second = np.append(flat[1:], 0)
    third = np.where(second > 0, np.append(second[1:], 0), 0)
    is_word = flat > 0
    vocabulary = list(number)
    vocabulary[0] = b""
    order = sorted(range(len(vocabulary)), key=vocabulary.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = [vocabulary[i] for i in order]
    used, head = np.unique(lang[is_word] * len(words) + rank[flat[is_word]], return_inverse=True)
    heads = [named[i // len(words)] + b"\t" + words[i % len(words)] for i in used.tolist()]
    order = sorted(range(len(heads)), key=heads.__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return automaton.Paths([heads[i] for i in order], words, place[head], rank[second[is_word]], rank[third[is_word]])


_PART = "rng int, block long, blob binary"


def _parts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["rng", "block", "blob"])


def _cut(paths: automaton.Paths, bounds: list, block: int) -> Iterator[pa.RecordBatch]:
    """One row per range that holds paths."""
    edges = paths.cut(bounds)
    for r, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            yield _parts([(r, block, paths.dump(a, b))])


def shard_counts(docs: DataFrame, bounds: list, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Count transducers of blocks of documents, cut at ``bounds``."""
    held = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def fresh() -> tuple:
            number = defaultdict()
            number.default_factory = number.__len__
            number[STOP]
            return number, [], [], 0

        number, langs, texts, size = fresh()
        for b in batches:
            for lang, text in rows_of(b):
                words = tokens(text)
                texts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                langs.append(lang)
                size += len(text)
                if size >= block_bytes:
                    yield from _cut(_paths(langs, texts, number), held.value, block)
                    number, langs, texts, size = fresh()
                    block += 1
        if texts:
            yield from _cut(_paths(langs, texts, number), held.value, block)

    return docs.mapInArrow(run, _PART)


def _unite(key: tuple, t: pa.Table) -> pa.Table:
    block = key[1].as_py() if len(key) > 1 else 0
    return pa.Table.from_batches([_parts([(key[0].as_py(), block, automaton.union(t.column("blob").to_pylist()).dump())])])


def _steps(ranges: int, fan: int) -> list[int]:
    """How many ranges a coarse range of each level holds: as few levels as ``fan`` allows, cut evenly."""
    levels = 1
    while fan ** levels < ranges:
        levels += 1
    width = next(w for w in range(1, fan + 1) if w ** levels >= ranges)
    return [width ** i for i in range(levels)]


def phrase_counts(docs: DataFrame, bounds: list, fan: int = FAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One count transducer per prefix range."""
    steps = _steps(len(bounds) + 1, fan)
    parts = shard_counts(docs, bounds[steps[-1] - 1::steps[-1]], block_bytes)
    for groups, step in zip(steps[:0:-1], steps[-2::-1]):  # unite coarse ranges in groups, cut each again
        grouped = parts.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(groups)))
        united = spread(grouped, "rng", "block").groupBy("rng", "block").applyInArrow(_unite, _PART)
        held = docs.sparkSession.sparkContext.broadcast(bounds)

        def finer(batches: Iterator[pa.RecordBatch], step=step, groups=groups) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rng, block, blob in rows_of(b):
                    for out in _cut(automaton.union([blob]), held.value[step - 1::step], rng * groups + block):
                        yield out

        parts = united.mapInArrow(finer, _PART)
    return cut_lineage(spread(parts, "rng").groupBy("rng").applyInArrow(_unite, _PART).drop("block"))


class Range:
    """A range's counts, its candidates and the phrases whose counts they need."""

    def __init__(self, blob: bytes, least: int):
        p = self.paths = automaton.Paths(*automaton.load(blob))
        self.at = p.starts(2)
        self.head, self.second = p.head[self.at], p.second[self.at]
        self.count = np.add.reduceat(p.weight, self.at) if len(self.at) else p.weight
        self.pair = self.head * len(p.words) + self.second
        heads = p.starts(1)
        self.total = np.add.reduceat(p.weight, heads) if len(heads) else p.weight
        self.twos = np.flatnonzero((self.second > 0) & (self.count >= least))
        self.threes = np.flatnonzero((p.third > 0) & (p.weight >= least))
        self.of_three = np.searchsorted(self.at, self.threes, "right") - 1
        self.places: list[dict[bytes, int]] | None = None

    def candidates(self) -> Iterator[tuple[bytes, list[bytes], int, int]]:
        """(lang, words, count, number of the two-word phrase it begins with or is)."""
        p = self.paths
        for i, a in zip(self.twos.tolist(), self.count[self.twos].tolist()):
            lang, word = p.heads[self.head[i]].rsplit(b"\t", 1)
            yield lang, [word, p.words[self.second[i]]], a, i
        for i, j in zip(self.threes.tolist(), self.of_three.tolist()):
            lang, word = p.heads[p.head[i]].rsplit(b"\t", 1)
            yield lang, [word, p.words[p.second[i]], p.words[p.third[i]]], int(p.weight[i]), j

    def requests(self, bounds: list) -> dict[int, dict[tuple[bytes, bytes], int]]:
        """By range: phrases of one word (no second label) or two, with the count of the most
        frequent candidate that ends with the two."""
        out: dict[int, dict[tuple[bytes, bytes], int]] = defaultdict(dict)

        def ask(head: bytes) -> None:
            for r in range(bisect_right(bounds, (head, b"")), bisect_left(bounds, (head + b"\0", b"")) + 1):
                out[r][head, b""] = 0

        for lang, words, a, _ in self.candidates():
            heads = [lang + b"\t" + w for w in words]
            ask(heads[0])
            ask(heads[-1])
            if len(words) == 3:
                key = heads[1], words[2]
                mine = out[bisect_right(bounds, key)]
                mine[key] = max(a, mine.get(key, 0))
        return out

    def answer(self, heads: list[bytes], words: list[bytes], ends: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Counts of requested phrases; ``longest`` takes the counts of the longer candidates."""
        p = self.paths
        if self.places is None:
            self.places = [{x: i for i, x in enumerate(labels)} for labels in (p.heads, p.words)]
        h, w = (np.array([at.get(x, -1) for x in labels], np.int64) for at, labels in zip(self.places, (heads, words)))
        key = h * len(p.words) + w
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        two = (h >= 0) & (w > 0) & (self.pair[i] == key)
        np.maximum.at(longest, i[two], ends[two])
        return np.where(two, self.count[i], np.where((h >= 0) & (w == 0), self.total[h], 0))

    def longest_within(self) -> np.ndarray:
        """Per two-word phrase, the count of the most frequent candidate that begins with it."""
        out = np.zeros(len(self.at), np.int64)
        np.maximum.at(out, self.of_three, self.paths.weight[self.threes])
        return out


_REPLY = "rng int, src int, blob binary"
_FOUND = "lang string, phrase string, a long, l long, r long, score long, rng int, n long"


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _reply(least: int, key: tuple, requests: pa.Table, counts: pa.Table) -> pa.Table:
    out = []
    if counts.num_rows and requests.num_rows:
        r = Range(counts.column("blob")[0].as_py(), least)
        longest = np.zeros(len(r.at), np.int64)
        me = counts.column("rng")[0].as_py()
        for src, blob in zip(requests.column("src").to_pylist(), requests.column("blob").to_pylist()):
            out.append((src, me, automaton.pack([r.answer(*automaton.unpack(blob, (0, 1)), longest)])))
        out.append((me, None, automaton.pack([longest])))
    return _rows(out, ["rng", "src", "blob"], [pa.int32(), pa.int32(), pa.binary()])


def _score(least: int, within: int, top: int, bounds, key: tuple, counts: pa.Table, replies: pa.Table) -> pa.Table:
    me = counts.column("rng")[0].as_py()
    r = Range(counts.column("blob")[0].as_py(), least)
    asked, seen, longest = r.requests(bounds.value), defaultdict(int), r.longest_within()
    for src, blob in zip(replies.column("src").to_pylist(), replies.column("blob").to_pylist()):
        got = automaton.unpack(blob, ())[0]
        if src is None:
            longest = np.maximum(longest, got)
        else:
            for k, n in zip(sorted(asked[src]), got.tolist()):
                seen[k] += n
    best = defaultdict(list)
    for lang, words, a, i in r.candidates():
        if len(words) == 2 and 100 * int(longest[i]) >= within * a:
            continue
        heads = [lang + b"\t" + w for w in words]
        cuts = [(seen[heads[0], b""], seen[heads[1], words[2] if len(words) == 3 else b""])]
        if len(words) == 3:
            cuts.append((int(r.count[i]), seen[heads[2], b""]))
        score, left, right = min(((SCALE * a * a // (x * y), x, y) for x, y in cuts), key=lambda s: s[0])
        best[lang].append((-score, -a, b" ".join(words), left, right))
    named = [h.rsplit(b"\t", 1)[0] for h in r.paths.heads]
    totals = defaultdict(int)
    for lang, n in zip(named, r.total.tolist()):
        totals[lang] += n
    text = partial(bytes.decode, encoding="utf-8", errors="replace")
    rows = [(text(lang), text(phrase), -a, x, y, -s, me, None) for lang, found in best.items() for s, a, phrase, x, y in sorted(found)[:top]]
    rows += [(text(lang), None, None, None, None, None, me, n) for lang, n in totals.items()]
    return _rows(rows, ["lang", "phrase", "a", "l", "r", "score", "rng", "n"], [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64()])


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, within: int = WITHIN, top: int = TOP,
         range_bytes: int = RANGE_BYTES, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """The ``top`` phrases of two to three words per language with their counts and scores."""
    rows, size = text_total(docs, text)
    docs = _labelled(docs, text, lang)
    bounds = _bounds(docs, min(MOST_RANGES, by_bytes(size, range_bytes)), rows, size)
    counts = phrase_counts(docs, bounds, fan, block_bytes)
    held = docs.sparkSession.sparkContext.broadcast(bounds)  # MOST_RANGES prefixes at most

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rng, blob in rows_of(b):
                for to, asked in Range(blob, least).requests(held.value).items():
                    keys = sorted(asked)
                    blob = automaton.pack([[k[0] for k in keys], [k[1] for k in keys], np.array([asked[k] for k in keys], np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([rng], pa.int32()), pa.array([blob], pa.binary())], ["rng", "src", "blob"])

    requests = spread(counts.select("rng", "blob").mapInArrow(ask, _REPLY), "rng")
    replies = cut_lineage(requests.groupBy("rng").cogroup(counts.groupBy("rng")).applyInArrow(partial(_reply, least), _REPLY))
    found = cut_lineage(spread(counts, "rng").groupBy("rng").cogroup(replies.groupBy("rng")).applyInArrow(partial(_score, least, within, top, held), _FOUND))
    discard(counts)
    discard(replies)
    totals = found.filter("n IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    kept = found.filter("n IS NULL").drop("n").withColumn("rng", F.pmod("rng", F.lit(SPLIT)))
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    for keys in (["lang", "rng"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return join_checked(kept.withColumn("rank", F.col("rank").cast("long")), totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

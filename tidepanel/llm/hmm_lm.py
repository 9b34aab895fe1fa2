"""Hidden Markov language model with Baum-Welch on Spark (operator 5).

Words fall into ``CLASSES`` hash classes. A hidden state emits a class, the class emits a
word by its smoothed count among the class's words, so the model has a fixed number of
parameters for any vocabulary while every word keeps its own exact corpus count:

    P(text) = sum over state paths of  prod  A(s, s') B(s', class(w)) P(w | class(w)),

the last token being ``end``. Counts of words and classes cover all training documents.
Baum-Welch starts from a bounded sample (``START_DOCS`` documents of any length, of longer ones a
stretch of ``START_WORDS`` words at a place given by the id's hash; only starting values come from
it, after ``START_ROUNDS`` rounds) and then passes over all training documents until the log
likelihood per token rises by less than ``RISE`` (``MOST_PASSES`` at most): tasks add up
expected counts with scaled forward and backward recursions in batches of documents, Spark
adds the tasks' sums, the driver normalises a table of fixed size. The score is the scaled
forward recursion over the whole text, exact. ``train`` returns the model and the likelihood that
each pass found.

Word counts travel as columnar blobs (see ``blobs``): each block of documents has its own
vocabulary, one exchange by hash range adds the counts up and returns them per block.

Edge cases: NULL and empty texts are the single token ``end``; a NULL ``doc_id`` trains and
is not held out; repeated rows count each; very long texts are scored whole in one pass with
memory in proportion to the text; without training documents the model is uniform over
classes and the base score is 0 per token; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tidepanel.llm.blobs import range_edges, squeeze, unsqueeze
from tidepanel.llm.common import by_bytes, cut_lineage, fold, rows_of, text_bytes, text_total

STATES = 8
CLASSES = 4096
RISE = 0.005
MOST_PASSES = 8
START_DOCS = 400
START_WORDS = 1500
START_ROUNDS = 4
BLOCK_BYTES = 6 << 20
RANGE_BYTES = 8 << 20
LONG = 2048
PRIOR = 50.0
SEED = 5

_ENCODED = "block long, rng int, keys binary, counts binary, ids binary, perm binary, doc_ids array<long>, held array<boolean>, lengths array<int>"
_NAMES = ["block", "rng", "keys", "counts", "ids", "perm", "doc_ids", "held", "lengths"]
_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())]


def encode(docs: DataFrame, folds: int, held: int, text: str, ranges: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: one row with word numbers (``rng`` -1), and one row per hash range
    with the block's words of that range and their training counts."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held"),
                      text_bytes(text).alias("text"))

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        vocab: dict[bytes, int] = {}
        docs_, held_, lengths, ids, size = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal vocab, docs_, held_, lengths, ids, size, block
            if not docs_:
                return
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            train = flat[np.repeat(~np.array(held_, bool), lengths)]
            counts = np.bincount(train, minlength=len(vocab))
            common = np.argsort(-np.bincount(flat, minlength=len(vocab)), kind="stable")  # frequent words get small numbers
            number = np.empty(len(vocab), np.uint32)
            number[common] = np.arange(len(vocab), dtype=np.uint32)
            keys = np.fromiter((xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype("<u4")
            yield row(block, -1, None, None, squeeze(number[flat]), squeeze(number[order]), docs_, held_, lengths)
            edge = range_edges(keys, ranges)
            for r in range(ranges):
                a, b = edge[r], edge[r + 1]
                if b > a:
                    yield row(block, r, keys[a:b].tobytes(), squeeze(counts[a:b]), None, None, None, None, None)
            vocab, docs_, held_, lengths, ids, size = {}, [], [], [], [], 0
            block += 1

        for b in batches:
            for doc, out, t in rows_of(b):
                words = t.lower().split()
                number = vocab.setdefault
                ids.append(np.fromiter((number(w, len(vocab)) for w in words), np.uint32, len(words)))
                docs_.append(doc)
                held_.append(out)
                lengths.append(len(words))
                size += len(t)
                if size >= block_bytes:
                    yield from flush()
        yield from flush()

    return src.mapInArrow(run, _ENCODED)


_TOTALS = "block long, rng int, totals binary, class int, n long, v long"


def _add_up(classes: int):
    """One hash range of all blocks: each block's words with their counts over all blocks,
    and per class the sum and number of counted words."""
    def add(t: pa.Table) -> pa.Table:
        blocks, rng = t.column("block").to_pylist(), t.column("rng")[0].as_py()
        keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
        counts = [unsqueeze(c) for c in t.column("counts").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        cls = (distinct % np.uint64(classes)).astype(np.int64)
        n = np.bincount(cls, weights=total, minlength=classes).astype(np.int64)
        v = np.bincount(cls[total > 0], minlength=classes)
        used = np.flatnonzero(n)
        ends = np.cumsum([len(k) for k in keys])
        if total.max(initial=0) > 0xFFFFFFFF:
            raise OverflowError("a word occurs more than 2^32 - 1 times; its count does not fit the exchange")
        blobs = [squeeze(total[at[e - len(k):e]]) for k, e in zip(keys, ends)]
        codes = [squeeze(cls[at[e - len(k):e]]) for k, e in zip(keys, ends)]
        none = [None] * len(blocks)
        packed = [len(x).to_bytes(8, "little") + x + y for x, y in zip(blobs, codes)]
        return pa.table([pa.array(blocks + [None] * len(used), pa.int64()), pa.array([rng] * (len(blocks) + len(used)), pa.int32()),
                         pa.array(packed + [None] * len(used), pa.binary()), pa.array(none + used.tolist(), pa.int32()),
                         pa.array(none + n[used].tolist(), pa.int64()), pa.array(none + v[used].tolist(), pa.int64())],
                        names=["block", "rng", "totals", "class", "n", "v"])

    return add


_CODED = "block long, codes binary, doc_ids array<long>, held array<boolean>, lengths array<int>, known array<int>, base array<double>, inner array<double>"


def _code(all_tokens: int, all_words: int, inside: np.ndarray):
    """Per block: class codes of its documents, known tokens, base log10 probability and the
    log10 probability of the words given their classes."""
    def code(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({f: pa.array([], t) for f, t in zip(
                ["block", "codes", "doc_ids", "held", "lengths", "known", "base", "inner"],
                [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())])})
        got = sorted(zip(totals.column("rng").to_pylist(), totals.column("totals").to_pylist()))
        cut = [(x[8:8 + int.from_bytes(x[:8], "little")], x[8 + int.from_bytes(x[:8], "little"):]) for _, x in got]
        perm = unsqueeze(docs.column("perm")[0].as_py())
        total, cls = np.zeros(len(perm), np.int64), np.zeros(len(perm), np.uint32)
        if cut:
            total[perm] = np.concatenate([unsqueeze(a) for a, _ in cut])
            cls[perm] = np.concatenate([unsqueeze(b) for _, b in cut])
        ids = unsqueeze(docs.column("ids")[0].as_py())
        lengths = np.array(docs.column("lengths")[0].as_py(), np.int64)
        edge = np.concatenate([[0], np.cumsum(lengths)])

        def per_doc(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(values[ids])])[edge])

        return pa.table({
            "block": docs.column("block"), "codes": pa.array([squeeze(cls[ids])]), "doc_ids": docs.column("doc_ids"), "held": docs.column("held"),
            "lengths": docs.column("lengths"), "known": pa.array([per_doc((total > 0).astype(np.int64)).astype(np.int32).tolist()], pa.list_(pa.int32())),
            "base": pa.array([per_doc(np.log10((total + 1) / (all_tokens + all_words + 1))).tolist()]),
            "inner": pa.array([per_doc(np.log10((total + 1) / inside[cls])).tolist()])})

    return code


class Model:
    """Start (k), moves (k x k) and emissions (classes + 1 rows x k) of the hidden states."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit

    def as_type(self, kind) -> Model:
        return Model(self.start.astype(kind), self.moves.astype(kind), np.ascontiguousarray(self.emit.astype(kind)))


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents by descending length, and how many are still open at each step."""
    order = np.argsort(-lengths, kind="stable")
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), "right")
    return order, alive


def forward(m: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """log P of each sequence by the scaled forward recursion; with ``keep`` also the scaled
    vectors and scales by step."""
    order, alive = layout(lengths)
    at = starts[order]
    out = np.zeros(len(order))
    a, kept = None, []
    for t, n in enumerate(alive.tolist()):
        e = m.emit[codes[at[:n] + t]]
        a = m.start * e if a is None else (a[:n] @ m.moves) * e
        c = a.sum(1)
        a /= c[:, None]
        out[:n] += np.log(c)
        if keep:
            kept.append((a, c))
    logp = np.empty(len(order))
    logp[order] = out
    return (logp, order, alive, kept) if keep else logp


def expected(m: Model, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sums: list[np.ndarray]) -> float:
    """Adds the expected counts of the sequences to ``sums`` = [start, moves, emit]; log P."""
    logp, order, alive, kept = forward(m, codes, starts, lengths, keep=True)
    at, k = starts[order], len(m.start)
    gammas, where = [], []
    right = None  # emission times backward vector over scale of the next step
    for t in range(len(kept) - 1, -1, -1):
        a, _ = kept[t]
        n = len(a)
        b = np.ones((n, k), a.dtype)
        if right is not None:
            nx = len(right)
            b[:nx] = right @ m.moves.T
            sums[1] += a[:nx].T @ right
        g = a * b
        where.append(codes[at[:n] + t])
        gammas.append(g)
        if t:
            right = m.emit[where[-1]] * b / kept[t][1][:, None]
        else:
            sums[0] += g.sum(0)
        kept[t] = None
    if gammas:
        c, g = np.concatenate(where), np.concatenate(gammas)
        for s in range(k):
            sums[2][:, s] += np.bincount(c, weights=g[:, s], minlength=len(sums[2]))
    return float(logp.sum())


def normalised(m: Model, sums: list[np.ndarray], unigram: np.ndarray, prior: float = PRIOR) -> Model:
    """The M step: expected counts with a little of the unigram mixed in."""
    start, moves, emit = sums[0] + 0.1, sums[1] * m.moves + 0.1, sums[2] + prior * unigram[:, None]
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def fresh(m: Model) -> list[np.ndarray]:
    return [np.zeros(len(m.start)), np.zeros((len(m.start),) * 2), np.zeros(m.emit.shape)]


def starting_model(seqs: list[np.ndarray], classes: int, states: int, unigram: np.ndarray, rounds: int = START_ROUNDS, seed: int = SEED) -> Model:
    """Starting values: states begin as groups of alike documents, then some Baum-Welch
    rounds over these few documents."""
    rng = np.random.default_rng(seed)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    emit = unigram[:, None] * rng.gamma(20, 1 / 20, (classes + 1, states))
    m = Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
    if len(seqs) < 2 * states:
        return m
    hist = np.sqrt(np.stack([np.bincount(s[:-1], minlength=classes + 1) / max(len(s) - 1, 1) for s in seqs]))
    centre = [hist[0]]
    for _ in range(states - 1):  # spread-out seeds
        centre.append(hist[np.argmin(np.max(np.stack([hist @ c for c in centre]), 0))])
    for _ in range(10):
        near = np.argmax(hist @ np.stack(centre).T, 1)
        centre = [hist[near == j].mean(0) if (near == j).any() else hist[rng.integers(len(hist))] for j in range(states)]
        centre = [c / max(np.linalg.norm(c), 1e-12) for c in centre]
    emit = np.stack([c * c for c in centre], 1) * 0.7 + emit / emit.sum(0) * 0.3
    m = Model(m.start, m.moves, emit / emit.sum(0))
    codes, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for _ in range(rounds):
        sums = fresh(m)
        expected(m.as_type(np.float32), codes, starts, lengths, sums)
        m = normalised(m, sums, unigram)
    return m


def with_end(codes: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with ``end`` after each document, and the documents' starts and lengths."""
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    out = np.full(int(lengths.sum()) + len(lengths), end, np.int64)
    where = np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)
    out[where] = codes
    return out, starts, lengths + 1


def _pass(coded: DataFrame, m: Model, classes: int) -> tuple[list[np.ndarray], float]:
    """One E step over all training documents: expected counts added up over tasks, and the log
    likelihood of the documents' classes."""
    k = len(m.start)
    light = m.as_type(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = fresh(m)
        late: list[np.ndarray] = []
        waiting, logp = 0, 0.0

        def work(seqs: list[np.ndarray]) -> float:
            lengths = np.array([len(s) for s in seqs], np.int64)
            return expected(light, np.concatenate(seqs), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths, sums)

        for b in batches:
            for codes, held, lengths in rows_of(b):
                codes, starts, lengths = with_end(unsqueeze(codes), np.array(lengths, np.int64), classes)
                train = ~np.array(held, bool)
                short = train & (lengths <= LONG)
                if short.any():
                    logp += expected(light, codes, starts[short], lengths[short], sums)
                for i in np.flatnonzero(train & ~short):  # few long ones share their steps
                    late.append(codes[starts[i]:starts[i] + lengths[i]].astype(np.uint16))
                    waiting += int(lengths[i])
                    if waiting >= 1_000_000:
                        logp += work(late)
                        late, waiting = [], 0
        if late:
            logp += work(late)
        emit = sums[2]
        used = np.flatnonzero(emit.any(1))
        rows = [*emit[used].tolist(), sums[0].tolist(), *sums[1].tolist(), [logp] + [0.0] * (k - 1)]
        keys = [*used.tolist(), *range(classes + 1, classes + 3 + k)]
        cols = np.array(rows, float).reshape(-1, k).T
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *map(pa.array, cols)], ["at", *(f"s{i}" for i in range(k))])

    out = coded.select("codes", "held", "lengths").mapInArrow(run, "at int, " + ", ".join(f"s{i} double" for i in range(k)))
    got, total = fresh(m), 0.0
    for r in out.groupBy("at").agg(*(F.sum(f"s{i}") for i in range(k))).collect():  # classes + states + 3 rows
        if r[0] <= classes:
            got[2][r[0]] = r[1:]
        elif r[0] == classes + 1:
            got[0][:] = r[1:]
        elif r[0] == classes + 2 + k:
            total = r[1]
        else:
            got[1][r[0] - classes - 2] = r[1:]
    return got, total


def train(coded: DataFrame, m: Model, classes: int, unigram: np.ndarray, tokens: int, rise: float = RISE, most: int = MOST_PASSES) -> tuple[Model, list[float]]:
    """Baum-Welch over all training documents; the model and the log likelihood per token that each
    pass found (that of the model before its update)."""
    found: list[float] = []
    while tokens and len(found) < most and (len(found) < 2 or found[-1] - found[-2] >= rise):
        sums, logp = _pass(coded, m, classes)
        m = normalised(m, sums, unigram)
        found.append(logp / tokens)
    return m, found


def _sample(coded: DataFrame, docs: int, classes: int, total: int, words: int = START_WORDS) -> list[np.ndarray]:
    """Class sequences of at most ``docs`` training documents, picked by hash of the id; of long
    ones a stretch of ``words`` words."""
    bar = min(1.0, 2.0 * docs / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picked = []
            for codes, ids, held, lengths in rows_of(b):
                lengths = np.array(lengths, np.int64)
                edge = np.concatenate([[0], np.cumsum(lengths)])
                all_codes = None
                for i, (doc, out) in enumerate(zip(ids, held)):
                    h = xxh64_intdigest(str(doc), SEED)
                    if not out and h < bar * 2 ** 64 and lengths[i]:
                        all_codes = unsqueeze(codes) if all_codes is None else all_codes
                        at = int(edge[i]) + h % max(1, int(lengths[i]) - words + 1)
                        picked.append((h >> 1, all_codes[at:min(at + words, int(edge[i + 1]))].tobytes()))
            if picked:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in picked], pa.int64()), pa.array([p[1] for p in picked])], ["h", "codes"])

    got = coded.select("codes", "doc_ids", "held", "lengths").mapInArrow(run, "h long, codes binary").orderBy("h", "codes").limit(docs).collect()
    return [np.append(np.frombuffer(r[1], "<u4").astype(np.int64), classes) for r in got]


def score(docs: DataFrame, folds: int = 7, held: int = 2, text: str = "text", states: int = STATES, classes: int = CLASSES,
          rise: float = RISE, most: int = MOST_PASSES, start_docs: int = START_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per document.
    Documents whose fold is ``held`` are scored and not learned from."""
    rows, size = text_total(docs.select(F.col(text).alias("text")))
    ranges = by_bytes(size, RANGE_BYTES)
    encoded = cut_lineage(encode(docs, folds, held, text, ranges, block_bytes))
    totals = cut_lineage(encoded.filter("rng >= 0").select("block", "rng", "keys", "counts").repartition(ranges, "rng")
                         .groupBy("rng").applyInArrow(_add_up(classes), _TOTALS))
    per_class = np.zeros((classes, 2), np.int64)
    for c, n, v in totals.filter("class is not null").groupBy("class").agg(F.sum("n"), F.sum("v")).collect():
        per_class[c] = n, v
    blocks = encoded.filter("rng < 0")
    train_docs = blocks.select(F.explode("held").alias("h")).agg(F.sum((~F.col("h")).cast("long"))).first()[0] or 0
    words, kinds = (int(x) for x in per_class.sum(0))
    all_tokens, all_kinds = words + train_docs, kinds + (train_docs > 0)
    inside = (per_class.sum(1) + 1).astype(float)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_bytes(size, 2 * block_bytes))
    left = blocks.select("block", "ids", "perm", "doc_ids", "held", "lengths").repartition(parts, "block")
    right = totals.filter("class is null").select("block", "rng", "totals").repartition(parts, "block")
    coded = cut_lineage(left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_code(all_tokens, all_kinds, inside), _CODED))
    unigram = np.append(per_class[:, 0], train_docs).astype(float) + 0.5
    unigram /= unigram.sum()
    m = starting_model(_sample(coded, start_docs, classes, rows), classes, states, unigram)
    m, _ = train(coded, m, classes, unigram, all_tokens, rise, most)
    base_end = float(np.log10((train_docs + 1) / (all_tokens + all_kinds + 1)))
    end_known = int(train_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, waiting = [], 0

        def work(group: list) -> pa.RecordBatch:
            lengths = np.array([len(g[0]) for g in group], np.int64)
            logp = forward(m, np.concatenate([g[0] for g in group]), np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            doc, out, known, base, inner = (list(x) for x in zip(*(g[1:] for g in group)))
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(out), pa.array(lengths), pa.array(np.array(known, np.int64) + end_known),
                 pa.array(np.full(len(doc), all_tokens)), pa.array(np.array(base) + base_end), pa.array(np.array(inner) + logp / np.log(10))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            for codes, ids, out, lengths, known, base, inner in rows_of(b):
                codes, starts, lengths = with_end(unsqueeze(codes), np.array(lengths, np.int64), classes)
                each = [(codes[s:s + n].astype(np.uint16), *r) for s, n, *r in zip(starts, lengths, ids, out, known, base, inner)]
                short = [e for e in each if len(e[0]) <= LONG]
                if short:
                    yield work(short)
                for e in each:
                    if len(e[0]) > LONG:
                        late.append(e)
                        waiting += len(e[0])
                        if waiting >= 2_000_000:
                            yield work(late)
                            late, waiting = [], 0
        if late:
            yield work(late)

    return coded.select("codes", "doc_ids", "held", "lengths", "known", "base", "inner").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

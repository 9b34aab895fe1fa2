"""N-gram Jaccard join by a size-aware heavy-light scheme (operator 9).

Documents are sets of distinct word n-grams; two link when their Jaccard similarity reaches
the threshold. The join is exact up to collisions of 48-bit n-gram keys and returns the
connected components of the links.

1. *Counts.* Blocks of documents send their keys, sorted and delta-coded, to hash ranges (see
   ``blobs``); the range counts in how many different sets a key occurs. Keys of one set only
   cannot be shared. A set with more of these than a partner may miss has no partner and
   leaves here, and so do further copies of a set: one carrier stays.
2. *Light sets* (up to the boundary): all subsets of ``SUBSET`` keys among the rarest keys
   that must contain a shared subset. *Heavy sets*: inverted lists over the rarest keys,
   scanned. With ``o`` the least overlap of a set of n keys, ``n - o + SUBSET`` (light) or
   ``n - o + 1`` (heavy) rarest keys are enough. Sets whose partners may be heavy take part
   in both. The boundary is where the sum of both costs is least, from counts by set size: a
   row of a subset costs 1, a row of a list 1 + ``SCAN`` because one shared key leads to a
   comparison more often than two.
3. *Scan.* Members of a list (a subset or a key) are compared with one hub of it, chosen by
   hash, each with its most frequent hub. Groups of near copies become components in a few
   such rounds, without their pairs.
4. *Rest, exact.* Lists whose members still lie in different components are the only place
   for missing links. Their members are cut into chunks of bounded keys and sets; chunks that
   meet in a list are compared as blocks with matrix products, each pair of chunks once.

Edge cases: a NULL text, or one without words, is an empty set and links with nothing; fewer
words than n make one n-gram; copies and repeated rows share a component; a NULL ``doc_id``
may connect others, but never names a component unless it has no partner with an id; rows
with the same ``doc_id`` and different texts are different sets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.blobs import squeeze, unsqueeze
from tidepanel.llm.common import by_bytes, cut_lineage, join_checked, mix64, rows_of, text_bytes, text_total, word_hash
from tidepanel.llm.components import components

WIDTH = 5
PERCENT = 80
SUBSET = 2
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
CHUNK_KEYS = 1 << 17
CHUNK_SETS = 2_000
TILE_ROWS = 256
ROUNDS = 2
SCAN = 3
BITS = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)

_BLOBS = "block long, rng int, keys binary, sets binary, marks binary, owners binary, doc_ids array<long>, n array<int>, h1 array<long>, h2 array<long>, carrier array<int>"
_BLOB_NAMES = ["block", "rng", "keys", "sets", "marks", "owners", "doc_ids", "n", "h1", "h2", "carrier"]
_BLOB_TYPES = [pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def shingles(text: bytes, hashes: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lowered."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = max(n - width + 1, 1)
    k = min(n, width)
    out = h[:m].copy()
    for i in range(1, k):
        out = out * _STEP + h[i:i + m]
    if k < width:
        out = out + np.uint64(k)
    return np.unique(mix64(out))


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys that a set of n keys shares at least with any linked set."""
    return -(-percent * n // 100)


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in 4 bytes each when they fit."""
    d = np.diff(keys, prepend=np.uint64(0))
    wide = bool(len(d) > 1 and int(d[1:].max()) >> 32)
    return bytes([wide]) + keys[:1].tobytes() + d[1:].astype("<u8" if wide else "<u4").tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u8", 1, 1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, "<u8" if data[0] else "<u4", -1, 9).astype(np.uint64)]), dtype=np.uint64)


def blocks(docs: DataFrame, ranges: int, text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: a row of document facts (negative ``rng``) and a row per hash
    range with the keys of the block's different sets."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    firsts = np.array([-(-(r << BITS) // ranges) for r in range(1, ranges)], np.uint64)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOB_TYPES)], _BLOB_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, hashes = part << 32, word_hash()
        ids, sizes, h1, h2, carrier, sets, size = [], [], [], [], [], [], 0
        seen: dict[tuple[int, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, sizes, h1, h2, carrier, sets, size, seen
            if not ids:
                return
            yield row(block, -1 - (part + (block & 0xFFFFFFFF)) % ranges, None, None, None, None, ids, sizes, h1, h2, carrier)
            if sets:
                marks = np.array(list(seen), np.int64).reshape(-1, 2)[:, 0].copy()
                keys = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
                order = np.argsort(keys)
                keys, owner = keys[order], owner[order]
                edge = np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])
                for r in np.flatnonzero(np.diff(edge)).tolist():  # ranges that hold keys
                    a, b = int(edge[r]), int(edge[r + 1])
                    if b > a:
                        used, at = np.unique(owner[a:b], return_inverse=True)
                        yield row(block, r, _deltas(keys[a:b]), squeeze(used), marks[used].tobytes(),
                                  at.astype("<u2" if len(used) < 65536 else "<u4").tobytes(), None, None, None, None, None)
            ids, sizes, h1, h2, carrier, sets, size, seen = [], [], [], [], [], [], 0, {}
            block += 1

        for b in batches:
            for doc, t in rows_of(b):
                s = shingles(t, hashes, width)
                with np.errstate(over="ignore"):
                    x = int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                    y = int((mix64(s ^ _STEP) * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                ids.append(doc)
                sizes.append(len(s))
                h1.append(x)
                h2.append(y)
                if len(s) and (x, y) not in seen:
                    carrier.append(len(sets))
                    seen[x, y] = len(sets)
                    sets.append(s >> np.uint64(64 - BITS))
                else:
                    carrier.append(-1)
                size += len(t)
                if size >= block_bytes:
                    yield from flush()
        yield from flush()
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, _BLOBS)


_SHARED = "block long, rng int, keys binary, owners binary, freq binary, doc_ids array<long>, n array<int>, h1 array<long>, h2 array<long>, carrier array<int>"
_SHARED_NAMES = ["block", "rng", "keys", "owners", "freq", "doc_ids", "n", "h1", "h2", "carrier"]
_SHARED_TYPES = [_BLOB_TYPES[0], _BLOB_TYPES[1], *[pa.binary()] * 3, *_BLOB_TYPES[6:]]


def shared_keys(t: pa.Table) -> pa.Table:
    """One hash range of all blocks: back to each block the keys that occur in two or more
    different sets, with their number of sets; of equal sets only the first keeps its keys."""
    if t.column("rng")[0].as_py() < 0:
        none = pa.nulls(t.num_rows, pa.binary())
        return pa.table([t.column("block"), t.column("rng"), none, none, none, *(t.column(c) for c in _BLOB_NAMES[6:])], names=_SHARED_NAMES)
    t = t.sort_by("block")
    keys, owner, mark, at = [], [], [], []
    for i, (k, s, m, o) in enumerate(zip(*(t.column(c).to_pylist() for c in ("keys", "sets", "marks", "owners")))):
        used, marks = unsqueeze(s), np.frombuffer(m, np.int64)
        o = np.frombuffer(o, "<u2" if len(used) < 65536 else "<u4")
        keys.append(_undeltas(k))
        owner.append(used[o])
        mark.append(marks[o])
        at.append(np.full(len(o), i, np.int32))
    keys, owner, mark, at = map(np.concatenate, (keys, owner, mark, at))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = order[np.lexsort((owner[order], at[order], mark[order], keys[order]))]
    k, m = keys[order], mark[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])[:len(k)]
    new_set = new_key | np.concatenate([[True], m[1:] != m[:-1]])[:len(k)]
    order, k, new_key = order[new_set], k[new_set], new_key[new_set]
    group = np.cumsum(new_key) - 1
    freq = np.bincount(group)[group] if len(group) else np.zeros(0, np.int64)
    keep = freq > 1
    order, k, freq = order[keep], k[keep], freq[keep]
    out = []
    by_block = np.argsort(at[order], kind="stable")
    edge = np.searchsorted(at[order][by_block], np.arange(t.num_rows + 1))
    for i, block in enumerate(t.column("block").to_pylist()):
        pick = by_block[edge[i]:edge[i + 1]]
        if len(pick):
            out.append((block, _deltas(k[pick]), owner[order[pick]].astype("<u4").tobytes(), squeeze(freq[pick])))
    rng = t.column("rng")[0].as_py()
    cols = list(zip(*out)) or [(), (), (), ()]
    arrays = [pa.array(cols[0], pa.int64()), pa.array([rng] * len(out), pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])]
    pa.default_memory_pool().release_unused()
    return pa.table([*arrays, *(pa.nulls(len(out), x) for x in _SHARED_TYPES[5:])], names=_SHARED_NAMES)


_SETS = "v long, h2 long, n int, alone int, keys binary, lists long, pairs long"


def _gather(percent: int, subset: int):
    """One block: the sets that may have a partner, with their shared keys from rarest to
    most frequent, and what listing and pairing them costs."""
    def gather(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        facts = next(r for r in rows if r["rng"] < 0)
        carrier = np.array(facts["carrier"], np.int64)
        at = np.flatnonzero(carrier >= 0)
        n = np.array(facts["n"], np.int64)[at]
        h1, h2 = np.array(facts["h1"], np.int64)[at], np.array(facts["h2"], np.int64)[at]
        parts = [r for r in rows if r["rng"] >= 0]
        owner = np.concatenate([np.frombuffer(r["owners"], "<u4") for r in parts]) if parts else np.zeros(0, np.uint32)
        keys = np.concatenate([_undeltas(r["keys"]) for r in parts]) if parts else np.zeros(0, np.uint64)
        freq = np.concatenate([unsqueeze(r["freq"]) for r in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        alone = n - np.bincount(owner, minlength=len(n))
        first = n - least_overlap(n, percent) + 1
        open_ = alone < first
        keep = open_[owner]
        owner, keys, freq = owner[keep], keys[keep], freq[keep]
        order = np.lexsort((keys, freq, owner))
        owner, keys, freq = owner[order], keys[order], freq[order]
        edge = np.searchsorted(owner, np.arange(len(n) + 1))
        out = []
        for i in np.flatnonzero(open_):
            a, b = edge[i], edge[i + 1]
            k = int(first[i] - alone[i])
            j = k + subset - 1
            out.append((int(h1[i]), int(h2[i]), int(n[i]), int(alone[i]), keys[a:b].tobytes(), k, j * (j - 1) // 2))
        cols = list(zip(*out)) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 2]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["v", "h2", "n", "alone", "keys", "lists", "pairs"])

    return gather


def boundary(sets: DataFrame, percent: int = PERCENT, scan: float = SCAN) -> int:
    """The set size up to which subsets cost less than lists: sizes are binned by ratio, the
    cost of every bin edge follows from sums per bin."""
    grade = F.floor(F.log("n") / F.log(F.lit(1.05))).cast("int")
    bins = sorted(sets.groupBy(grade.alias("g")).agg(F.max("n"), F.sum("pairs"), F.sum("lists") * (1 + scan)).collect())
    best, cost = 0, sum(b[3] for b in bins)
    for top in (b[1] for b in bins):
        c = sum(b[2] for b in bins if b[1] <= top) + sum(b[3] for b in bins if 100 * b[1] > percent * top)
        if c < cost:
            best, cost = top, c
    return best


def listed(sets: DataFrame, bound: int, percent: int = PERCENT, subset: int = SUBSET) -> DataFrame:
    """``sig, v, n``: the key subsets of light sets and the inverted lists of heavy ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, v, n = [], [], []
            for vertex, size, alone, keys in rows_of(b):
                keys = np.frombuffer(keys, np.uint64)
                first = size - int(least_overlap(np.int64(size), percent)) + 1 - alone
                if 100 * size > percent * bound:
                    s = keys[:first]
                    sig.append(s)
                    v.append(np.full(len(s), vertex))
                    n.append(np.full(len(s), size, np.int32))
                if size <= bound:
                    some = np.sort(keys[:first + subset - 1])
                    i, j = np.triu_indices(len(some), 1)
                    with np.errstate(over="ignore"):
                        s = mix64(some[i] * _STEP + some[j]) | np.uint64(1 << 63)
                    sig.append(s)
                    v.append(np.full(len(s), vertex))
                    n.append(np.full(len(s), size, np.int32))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(v)), pa.array(np.concatenate(n))], ["sig", "v", "n"])

    return sets.select("v", "n", "alone", "keys").mapInArrow(run, "sig long, v long, n int")


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` of sets that reach the threshold."""
    side = lambda x: sets.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("keys").alias(f"k_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "k_a", "k_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for _, _, n, m, x, y in rows_of(b):
                o = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                ok.append(100 * o >= percent * (n + m - o))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _compare(percent: int):
    """One pair of chunks: overlaps of all sets of one side with all of the other by matrix
    products over the keys both hold; returns links that connect different components."""
    def compare(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist(), np.int8)
        v, comp, n = (t.column(c).to_numpy() for c in ("v", "comp", "n"))
        keys = [np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        has = [np.bincount(at[np.isin(owner, s)], minlength=len(distinct)) > 0 for s in (left, right)]
        both = np.flatnonzero(has[0] & has[1])
        place = np.full(len(distinct), -1)
        place[both] = np.arange(len(both))
        overlap = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(both), 4096):
            use = (place[at] >= lo) & (place[at] < lo + 4096)
            m = []
            for s in (left, right):
                row = np.full(len(keys), -1)
                row[s] = np.arange(len(s))
                pick = use & (row[owner] >= 0)
                x = np.zeros((len(s), min(4096, len(both) - lo)), np.float32)
                x[row[owner[pick]], place[at[pick]] - lo] = 1
                m.append(x)
            overlap += m[0] @ m[1].T
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for lo in range(0, len(left), TILE_ROWS):
            tile = left[lo:lo + TILE_ROWS]
            o = overlap[lo:lo + TILE_ROWS].astype(np.int64)
            hit = (100 * o >= percent * (n[tile][:, None] + n[right][None, :] - o)) & (comp[tile][:, None] != comp[right][None, :])
            for i, j in zip(*np.nonzero(hit)):
                p, q = find(int(comp[tile[i]])), find(int(comp[right[j]]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(v[tile[i]]), int(v[right[j]])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return compare


def join_sets(sets: DataFrame, lists: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, chunk_keys: int = CHUNK_KEYS,
              chunk_sets: int = CHUNK_SETS) -> DataFrame | None:
    """``v, comp`` of linked sets; None when nothing links. Lists and their heads are written
    before they are joined, so a list of any length can be split over tasks."""
    labels = None
    for r in range(rounds + 1):
        named = lists.withColumn("comp", F.col("v")) if labels is None else \
            lists.join(labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        named = cut_lineage(named.select("sig", "v", "n", "comp"))
        hub = F.min(F.struct(F.xxhash64("v", F.lit(r)).alias("o"), F.col("v").alias("hub"), F.col("n").alias("m"), F.col("comp").alias("hub_comp")))
        heads = cut_lineage(named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("v").alias("head"), hub.alias("h"))
                            .filter("lo <> hi").select("sig", "head", "h.hub", "h.m", "h.hub_comp"))
        if heads.isEmpty():
            return labels
        open_ = named.join(heads, "sig")
        if r < rounds:
            fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
            near = (open_.filter((F.col("comp") != F.col("hub_comp")) & fits).groupBy(F.col("v").alias("a"), F.col("hub").alias("b"))
                    .agg(F.count(F.lit(1)).alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")))
            found = links(near, sets, percent)
        else:
            found = _rest(cut_lineage(open_.select("sig", "v", "n", "comp", "head")), sets, percent, chunk_keys, chunk_sets)
        labels = components(found if labels is None else found.unionByName(labels.select(F.col("v").alias("a"), F.col("comp").alias("b"))))
    return labels


def _rest(open_: DataFrame, sets: DataFrame, percent: int, chunk_keys: int, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """All links between members of a list that lie in different components."""
    grade = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
    member = open_.groupBy("v", "n", "comp").agg(F.min("head").alias("head")).withColumn("grade", grade)
    size = member.groupBy("head", "grade").agg(F.ceil(F.greatest(F.sum("n") / chunk_keys, F.count(F.lit(1)) / chunk_sets)).alias("cuts"))
    member = cut_lineage(member.join(size, ["head", "grade"]).withColumn("cut", F.pmod(F.xxhash64("v"), "cuts"))
                         .select("v", "n", "comp", "grade", F.xxhash64("head", "grade", "cut").alias("chunk")))
    meets = open_.select("sig", "v").join(member, "v").select("sig", "chunk", "grade").distinct()
    other = meets.select("sig", F.col("chunk").alias("chunk2"), F.col("grade").alias("grade2"))
    cells = (meets.join(other, "sig").filter((F.col("chunk") <= F.col("chunk2")) & (F.abs(F.col("grade") - F.col("grade2")) <= 1))
             .select("chunk", "chunk2").distinct())
    sides = F.explode(F.when(F.col("chunk") == F.col("chunk2"), F.array(F.struct("chunk", F.lit(0).alias("side")))).otherwise(
        F.array(F.struct("chunk", F.lit(0).alias("side")), F.struct(F.col("chunk2").alias("chunk"), F.lit(1).alias("side")))))
    rows = cells.select("chunk", "chunk2", sides.alias("s")).select(F.xxhash64("chunk", "chunk2").alias("cell"), "s.chunk", "s.side")
    full = member.drop("grade").join(sets.select("v", "keys"), "v")
    return rows.join(full, "chunk").select("cell", "side", "v", "comp", "n", "keys").groupBy("cell").applyInArrow(_compare(percent), "a long, b long")


def join_documents(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, subset: int = SUBSET,
                   block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    _, size = text_total(docs.select(F.col(text).alias("text")))
    ranges = by_bytes(size, range_bytes)
    shared = cut_lineage(blocks(docs, ranges, text, width, block_bytes).repartition(ranges, "rng").groupBy("rng").applyInArrow(shared_keys, _SHARED))
    facts = shared.filter("rng < 0").select(F.explode(F.arrays_zip("doc_ids", "n", "h1", "h2")).alias("d")).select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.n").alias("n"), F.col("d.h1").alias("h1"), F.col("d.h2").alias("h2"))
    classes = cut_lineage(facts.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("least")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_bytes(size, 2 * block_bytes))
    sets = cut_lineage(shared.repartition(parts, "block").groupBy("block").applyInArrow(_gather(percent, subset), _SETS))
    lists = cut_lineage(listed(sets, boundary(sets, percent), percent, subset))
    labels = join_sets(sets, lists, percent, chunk_keys=chunk_keys)
    if labels is None:
        named = classes.withColumn("component_id", F.col("least"))
    else:
        tagged = classes.join(labels.withColumnRenamed("v", "h1"), "h1", "left").withColumn("comp", F.coalesce("comp", "h1"))
        least = tagged.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = cut_lineage(tagged.join(least, "comp"))
    named = named.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("n").alias("_n"), "component_id")
    return facts.join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("n") == F.col("_n")), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the
    smallest id stays, once; of rows that share id and text the first by its JSON text. Rows without
    an id stay unless their text is repeated. Rows travel in one struct, so no name can clash."""
    named = cut_lineage(join_documents(docs, text, **options))
    gone = named.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    # An id that also names its own component (the same id with another text) stays.
    gone = gone.join(named.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "doc_id", "left_anti")
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col(text).alias("words"))
    gone = gone.select(F.col("doc_id").alias("id"))
    left = join_checked(held, gone, "id", "left_anti")
    again = cut_lineage(named.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return left.select("row.*")
    same = F.col("id").eqNullSafe(F.col("again"))
    twice = left.join(again, same, "left_semi").groupBy("id", "words").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(again, same, "left_anti").select("row").unionByName(twice.select("row")).select("row.*")

"""Exact top-k inner products with norm-sorted blocks and SVD-rotated bounds (operator 2).

Vectors become whole numbers, floor(scale * x), so scores are exact. Candidates are sorted
by descending length and cut into blocks; queries are cut into blocks as well. All vectors
are rotated by the eigenvectors of the candidates' Gram matrix (the right singular vectors
of the data, from sums over all rows), which moves most of an inner product into the first
coordinates. For a query q and a candidate x with first parts q1, x1 and rests q2, x2,

    q.x <= q1.x1 + |q2| |x2|        and        q.x <= |q| |x|     (Cauchy-Schwarz),

so a pair whose bound is below the query's k-th best score so far needs no full product, and
a candidate block whose longest vector fails the second bound for every query of a block is
never paired with it. First thresholds come from the longest candidates; then every
remaining pair of blocks is one unit of work, and the bests of all pairs are merged.

Edge cases: vectors that are NULL, or hold a NULL or non-finite component, and rows without
an id take no part; shorter vectors count as padded with zeros; ties go to the smaller id;
a query with fewer than k candidates returns them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.llm.common import cut_lineage

K = 5
SCALE = 256
QUERY_BLOCK = 1024
BLOCK = 2048
STEP = 256
HEAD = 16
SLACK = 1e-5
_PACKED = "block long, n int, longest double, ids binary, ints binary, turned binary, norms binary"


def usable(id_col: str, vec_col: str) -> Column:
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok


def _ints(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whole-number vectors) of a batch of (id, vector)."""
    lists = batch.column(1)
    n, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim)[None, :] < n[:, None]] = np.floor(scale * flat).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), out


def gram(vectors: DataFrame, dim: int, scale: int) -> np.ndarray:
    """Sum of x x^T over all rows: per-task sums, then one aggregate over dim * dim keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for b in batches:
            x = _ints(b, dim, scale)[1].astype(float)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(g.ravel())], ["at", "v"])

    g = np.zeros(dim * dim)
    for r in vectors.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        g[r[0]] = r[1]
    return g.reshape(dim, dim)


def packed(vectors: DataFrame, turn: np.ndarray, scale: int, block: int, parts: int) -> DataFrame:
    """Blocks of up to ``block`` vectors by descending length, one row each."""
    dim = len(turn)

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _ints(b, dim, scale)[1].astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x * x).sum(1))], ["id", "vec", "square"])

    sized = vectors.mapInArrow(length, f"id long, vec {vectors.schema['vec'].dataType.simpleString()}, square double")
    keys = (F.desc("square"), F.xxhash64("id"))  # equal lengths may share a range bound: the hash splits them
    ordered = sized.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = made = 0

        def emit(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            b = t.combine_chunks().to_batches()[0]
            ids, x = _ints(b.select(["id", "vec"]), dim, scale)
            norms = np.sqrt(b.column("square").to_numpy())
            at = (b.column("part")[0].as_py() << 32) + made
            made += 1
            y = (x.astype(float) @ turn)
            cols = [[at], [len(ids)], [float(norms.max())], [ids.tobytes()], [x.tobytes()], [y.tobytes()], [norms.tobytes()]]
            types = [pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["block", "n", "longest", "ids", "ints", "turned", "norms"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            while rows >= block:
                t = pa.Table.from_batches(held)
                yield emit(t.slice(0, block))
                held, rows = t.slice(block).to_batches(), rows - block
        if rows:
            yield emit(pa.Table.from_batches(held))

    return cut_lineage(ordered.mapInArrow(pack, _PACKED))


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.n = k, n
        self.q = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.floor = floor  # lower bounds of the k-th best score

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(p) for p in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]
        full = np.flatnonzero(rank[keep] == self.k - 1)
        np.maximum.at(self.floor, self.q[full], self.score[full].astype(float))


def _block(ids: bytes, ints: bytes, turned: bytes, norms: bytes, dim: int):
    return (np.frombuffer(ids, np.int64), np.frombuffer(ints, np.int64).reshape(-1, dim),
            np.frombuffer(turned, float).reshape(-1, dim), np.frombuffer(norms, float))


def search_pair(query, cand, floor: np.ndarray, k: int, head: int = HEAD, step: int = STEP) -> Best:
    """The k best of each query of one block among one block of candidates. Pairs whose
    bound stays under the floor are skipped; bounds carry a slack for rounding."""
    qid, qx, qt, qn = query
    cid, cx, ct, cn = cand
    best = Best(len(qid), k, floor.copy())
    exact_float = len(qn) and len(cn) and float(qn.max()) * float(cn.max()) < 2.0 ** 52
    qf, cf = qx.astype(float), cx.astype(float)
    q_rest = np.sqrt(np.maximum((qt[:, head:] ** 2).sum(1), 0))
    c_rest = np.sqrt(np.maximum((ct[:, head:] ** 2).sum(1), 0))
    for a in range(0, len(cid), step):
        b = min(a + step, len(cid))
        slack = SLACK * qn * cn[a] + 1e-6
        live = np.flatnonzero(qn * cn[a] + slack >= best.floor)  # candidates from here on are not longer
        if not len(live):
            break
        bound = qt[live, :head] @ ct[a:b, :head].T + q_rest[live, None] * c_rest[None, a:b]
        i, j = np.nonzero((bound + slack[live, None] >= best.floor[live, None]) & (cid[None, a:b] != qid[live, None]))
        if not len(i):
            continue
        if exact_float and len(i) * 4 > bound.size:
            s = np.rint(qf[live] @ cf[a:b].T).astype(np.int64)[i, j]
        elif exact_float:
            s = np.concatenate([np.rint(np.einsum("nd,nd->n", qf[live[i[c:c + 65536]]], cf[a + j[c:c + 65536]])).astype(np.int64)
                                for c in range(0, len(i), 65536)])
        else:
            s = np.concatenate([(qx[live[i[c:c + 65536]]] * cx[a + j[c:c + 65536]]).sum(1) for c in range(0, len(i), 65536)])
        keep = s >= best.floor[live[i]]
        best.add(live[i[keep]], s[keep], cid[a + j[keep]])
    return best


def _search(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """Rows (query block's and candidate block's arrays, floors) to the bests of each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = [c[i].as_py() for c in b.columns]
                query, cand = _block(*r[0:4], dim), _block(*r[4:8], dim)
                floor = np.full(len(query[0]), -np.inf) if r[8] is None else np.frombuffer(r[8], float)
                best = search_pair(query, cand, floor, k)
                yield pa.RecordBatch.from_arrays([pa.array(query[0][best.q]), pa.array(best.id), pa.array(best.score)], ["query_id", "id", "score"])

    return pairs.mapInArrow(run, "query_id long, id long, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, query_block: int = QUERY_BLOCK, block: int = BLOCK, rows_per_task: int = 16_384) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query vector its ``k`` best among all
    ``vectors`` but the one with its own id."""
    clean = lambda df: df.filter(usable(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    base, asked = clean(vectors), clean(queries)
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    dim = max(dim, 1)
    turn = np.ascontiguousarray(np.linalg.eigh(gram(base, dim, scale))[1][:, ::-1])
    parts = max(1, -(-n // rows_per_task))
    cand = packed(base, turn, scale, block, parts)
    ask = packed(asked, turn, scale, query_block, max(1, parts // 16))
    q = ask.select(F.col("block").alias("qb"), F.col("longest").alias("q_long"), F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints"),
                   F.col("turned").alias("q_turned"), F.col("norms").alias("q_norms"))
    arrays = ["q_ids", "q_ints", "q_turned", "q_norms", "ids", "ints", "turned", "norms"]
    first = cand.orderBy("block").limit(1)  # one block of the longest candidates
    start = cut_lineage(_merged(_search(q.join(F.broadcast(first)).withColumn("floor", F.lit(None).cast("binary")).select(*arrays, "floor"), dim, k), k))
    # The k-th best so far of each query, in its block's order.
    floors = start.filter(F.col("rank") == k).select("query_id", F.col("score").alias("low"))
    flat = ask.select(F.col("block").alias("qb"), F.col("ids")).mapInArrow(_unpack, "qb long, at int, query_id long")
    low = flat.join(floors, "query_id", "left").groupBy("qb").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("low")))).alias("l"))
    low = low.select("qb", F.col("l.low").alias("lows"))
    ready = cut_lineage(q.join(low, "qb").mapInArrow(_with_floor(q.columns), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields) + ", floor binary, need double"))
    # A pair of blocks is worth work if some query's |q| * longest reaches its floor: longest >= need.
    heads = ready.select("qb", "need")
    tails = cand.join(first.select("block"), "block", "left_anti").select("block", "longest")
    cells = heads.join(tails, F.col("longest") >= F.col("need")).select("qb", "block")
    work = cells.join(ready.drop("need"), "qb").join(cand.drop("n", "longest"), "block").select(*arrays, "floor")
    found = start.drop("rank").unionByName(_search(work, dim, k))
    return _merged(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for qb, ids in zip(*(c.to_pylist() for c in b.columns)):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qb)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)],
                                             ["qb", "at", "query_id"])


def _with_floor(names: list[str]):
    """Adds the floors as an array and ``need``, the shortest length of a block that matters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floors, need = [], []
            for lows, norms in zip(b.column("lows").to_pylist(), b.column("q_norms").to_pylist()):
                f, n = np.array(lows, float), np.frombuffer(norms, float)
                floors.append(f.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(f <= 0, 0.0, np.where(n > 0, f / n, np.inf))
                need.append(float(least.min()) * (1 - 4 * SLACK) if len(f) else np.inf)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(floors, pa.binary()), pa.array(need)], [*names, "floor", "need"])

    return run

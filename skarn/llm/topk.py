"""Exact top-k inner-product search with block-at-a-time pruning (operator 9).

Vectors are cut into blocks of neighbouring rows; a block keeps its rows (the forward index) and, for each
dimension, the largest and the smallest value in it. For a query the sum over its terms of weight times that
extreme bounds every score in the block. Blocks are taken in the order of their bounds until the next bound is
below the k-th best score so far; ties are never cut off.

Blocks are stored in packs, and queries in chunks. Every chunk meets every pack, each such meeting being one row of
a join on a salt, so no side is broadcast and no pack is larger than PACK rows. A first meeting with a
single pack gives each query a floor that its final k-th best score can't be below.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import durable

BLOCK, PACK, CHUNK = 128, 8192, 512


def bisect_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which each run of ``leaf`` rows is narrow: halves along the widest dimension, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = x[rows]
        d = int((part.max(0) - part.min(0)).argmax())
        half = (len(rows) // 2 + leaf - 1) // leaf * leaf
        half = half if half < len(rows) else leaf
        rows = rows[np.argsort(part[:, d], kind="stable")]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """``id, v``: floor(scale * x) of usable vectors; null and empty vectors, null or non-finite components and null ids drop out.

    A finite component whose integer doesn't fit into 64 bits raises an error.
    """
    fits = lambda x: F.abs(x * F.lit(scale)) < F.lit(2.0**63)
    whole = lambda x: F.when(fits(x), F.floor(x * F.lit(scale)).cast("long")).otherwise(F.raise_error(F.lit("a component beyond 64 bits")).cast("long"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.transform(F.col(vec_col).cast("array<double>"), whole)
    ok = F.forall(F.col(vec_col).cast("array<double>"), fine) & (F.size(vec_col) > 0) & F.col(id_col).isNotNull()
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def narrow(x: np.ndarray) -> np.ndarray:
    """In 32 bits if all values fit."""
    return x.astype("<i4" if int(np.abs(x).max(initial=0)) < 2**31 else "<i8")


def matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * dim else "<i8").astype(np.int64).reshape(rows, dim)


def _packed(rows: DataFrame, size: int, reorder: bool) -> DataFrame:
    """``dim, ids, data``: rows of equal dimension as matrices of at most ``size`` rows."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, vecs = held.pop(dim)
            ids, x = np.array(ids, np.int64), np.array(vecs, np.int64)
            if reorder:
                by = bisect_order(x, BLOCK)
                ids, x = ids[by], x[by]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrow(x).tobytes()], pa.binary())], ["dim", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def product(a: np.ndarray, b: np.ndarray, clip: bool = False) -> np.ndarray:
    """Exact integer a @ b.T; by floating-point units where every sum stays below 2**53.

    Sums beyond 64 bits raise an error, or come as the nearest 64-bit integer with ``clip``.
    """
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if 0 <= most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if 0 <= most < 2**63:
        return a @ b.T
    out = a.astype(object) @ b.astype(object).T  # Python's integers
    if not clip and any(not -(2**63) <= x < 2**63 for x in out.ravel()):
        raise OverflowError("inner products beyond 64 bits")
    return np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in out], np.int64).reshape(out.shape)


class Pack:
    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = matrix(data, len(self.ids), dim)
        cuts = np.arange(0, len(self.ids), BLOCK)
        self.cuts = [*cuts.tolist(), len(self.ids)]
        self.hi = np.maximum.reduceat(self.x, cuts, axis=0)
        self.lo = np.minimum.reduceat(self.x, cuts, axis=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, blocks): no score of a block is above."""
        return product(np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1), np.concatenate([self.hi, self.lo], 1), clip=True)

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        """Best ``k`` of each query that reach its floor, and how many blocks were scored."""
        bound = self.bounds(q)
        order = np.argsort(bound, axis=1, kind="stable")[:, ::-1]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qid]
        kth = floor.copy()
        scored = 0
        live = np.arange(len(qid))
        for step in range(order.shape[1]):
            block = order[live, step]
            go = bound[live, block] >= kth[live]
            live, block = live[go], block[go]
            if not len(live):
                break
            scored += len(live)
            for b in np.unique(block).tolist():  # queries that meet at a block are scored together
                rows = live[block == b]
                i, j = self.cuts[b], self.cuts[b + 1]
                score = product(q[rows], self.x[i:j])
                ids = self.ids[i:j]
                for r, s in zip(rows.tolist(), score):
                    ok = np.flatnonzero((s >= kth[r]) & (ids != qid[r]))
                    if not len(ok):
                        continue
                    s, d = np.concatenate([best[r][0], s[ok]]), np.concatenate([best[r][1], ids[ok]])
                    top = np.lexsort((d, ~s))[:k]  # ~s orders like -s, without overflow
                    best[r] = s[top], d[top]
                    if len(top) == k:
                        kth[r] = max(kth[r], s[top[-1]])
        return best, kth, scored


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query among all other rows.

    Ties go to the smaller id. Rows that share the query's id are its own and never candidates; a query id that
    repeats counts once. Only vectors of the query's dimension are compared, and empty ones take no part. Components of any
    finite size do; scores are exact, and one beyond 64 bits raises an error. A task holds ``PACK`` vectors and ``CHUNK`` queries.
    """
    spark = vectors.sparkSession
    packs = durable(_packed(quantised(vectors, id_col, vec_col, scale), PACK, True).withColumn("pack", F.monotonically_increasing_id()), "packs", codec="none")
    asked = quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    chunks = durable(_packed(asked, CHUNK, False), "queries").withColumnRenamed("ids", "qids").withColumnRenamed("data", "q")

    def meet(rows, seed: bool):
        def run(batches):
            import pyarrow as pa

            last: tuple = (None, None)
            for b in batches:
                for dim, pack, ids, data, qids, q, floor in zip(*(c.to_pylist() for c in b.columns)):
                    if last[0] != pack:
                        last = pack, Pack(ids, data, dim)
                    qid = np.frombuffer(qids, np.int64)
                    q = matrix(q, len(qid), dim)
                    low = np.full(len(qid), -(2**63)) if floor is None else np.frombuffer(floor, np.int64)
                    best, kth, scored = last[1].search(qid, q, low, k)
                    if seed:
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([qids], pa.binary()), pa.array([kth.tobytes()], pa.binary())], ["dim", "qids", "floor"])
                        continue
                    n = [len(x[0]) for x in best]
                    cols = [np.repeat(qid, n), np.concatenate([x[1] for x in best]), np.concatenate([x[0] for x in best])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        schema = "dim int, qids binary, floor binary" if seed else "query_id long, vec_id long, score long"
        return rows.select("dim", "pack", "ids", "data", "qids", "q", "floor").mapInArrow(run, schema)

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    # For its floor each chunk meets one pack: that of the chunk's salt, or any where the salt has none.
    own = packs.groupBy("dim", deal("pack").alias("salt")).agg(F.min("pack").alias("own"))
    any_ = own.groupBy("dim").agg(F.min("own").alias("any"))
    seeds = chunks.withColumn("salt", deal("qids")).join(own, ["dim", "salt"], "left").join(any_, "dim").withColumn("pack", F.coalesce("own", "any"))
    seeds = seeds.drop("salt", "own", "any").join(packs.drop("dim"), "pack").withColumn("floor", F.lit(None).cast("binary"))
    floors = durable(meet(seeds, True), "floors")
    # Packs are dealt to salts, and every chunk to each salt: the pairs of a salt are one task's.
    asked = chunks.join(floors, ["dim", "qids"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    meetings = packs.withColumn("salt", deal("pack")).join(asked, ["dim", "salt"])
    best = meet(meetings, False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size; each block keeps one sorted
list for each dimension.  A query reads all lists in step, from the end
that its own component favours, scores the vectors it meets, and stops in a
block as soon as no unread vector can beat its kth score there.  The blocks'
answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapix.sources.store import materialize

SCALE = 64
TOP = 20
CANDIDATE_BLOCK = 8192  # vectors whose lists one task holds
QUERY_BLOCK = 1024      # queries that travel together
STEP = 64               # entries first read from each list; doubled every round
NO_ID = np.iinfo(np.int64).max

BLOCK = "dim int, block long, kind string, rows long, keys binary, ids binary, data binary"
FOUND = "qrid long, query_id long, vec_id long, score long"


def quantise(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as integers."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(finite(x), F.lit(False)))


class Lists:
    """One block's vectors and, for each dimension, their order by that component."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, keys: np.ndarray):
        self.ids, self.keys = ids, keys
        self.raw, self.top = data, int(np.abs(data).max(initial=0))
        self.cast: dict = {}
        self.order = np.argsort(data, axis=0, kind="stable")
        self.sorted = np.take_along_axis(data, self.order, axis=0)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, score) of every vector that may be among the k best, the query's own row left out."""
        n = len(self.ids)
        # Products and sums are exact in the chosen type.
        reach = max(self.top, 1) * int(np.abs(q).max(initial=0)) * len(q)
        kind = np.float32 if max(reach, self.top) < 1 << 24 else np.float64 if max(reach, self.top) < 1 << 53 else object
        if kind not in self.cast:
            self.cast[kind] = np.ascontiguousarray(self.raw.astype(kind))
        data, qk = self.cast[kind], q.astype(kind)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.keys == own
        pos, score = [], []
        kth, depth, step = None, 0, STEP
        while depth < n:
            stop = min(n, depth + step)
            fresh = np.zeros(n, dtype=bool)
            if len(up) + len(down):
                fresh[self.order[n - stop:n - depth, up]] = True
                fresh[self.order[depth:stop, down]] = True
            else:
                fresh[:] = True  # a zero query scores every vector 0
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            if len(new):
                pos.append(new)
                score.append(data[new] @ qk)
                allof = np.concatenate(score)
                if len(allof) >= k:
                    kth = np.partition(allof, len(allof) - k)[len(allof) - k]
            depth, step = stop, step * 2
            bound = (qk[up] @ self.sorted[n - depth, up].astype(kind)
                     + qk[down] @ self.sorted[depth - 1, down].astype(kind))
            if kth is not None and bound < kth:  # at a tie an unread vector could still win by its id
                break
        if not pos:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        p, s = np.concatenate(pos), np.concatenate(score)
        if kth is not None:
            p, s = p[s >= kth], s[s >= kth]
        if kind is object:
            s = np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in s], dtype=np.int64)
        s = s.astype(np.int64)
        best = np.lexsort((self.ids[p], ~s))[:k]  # ~s falls as s rises, and cannot overflow
        return p[best], s[best]


def with_nulls(ids: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(ids, ids == NO_ID)


def _pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rid")
    return pd.DataFrame({
        "dim": [np.int32(key[0])], "block": [np.int64(key[1])], "kind": [key[2]], "rows": [len(pdf)],
        "keys": [pdf["rid"].to_numpy(np.int64).tobytes()],
        "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
        "data": [np.stack(pdf["q"].to_numpy()).astype(np.int64).tobytes()]})


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, vec_id: str = "vec_id", vec: str = "embedding",
          scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best rows but itself, ties to the smaller vec_id.

    ``is_query`` chooses the query rows (a null counts as no).  Vectors null,
    empty, or with a null or non-finite component take no part, and vectors
    are compared with those of their own length.  Each repeated row is a
    query and a candidate of its own; a null vec_id comes last among ties.
    Sums beyond 64 bits are held at the ends of the range.
    """
    rows = (vectors.where(usable(F.col(vec)))
            .select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"),
                    F.coalesce(is_query, F.lit(False)).alias("ask"), quantise(F.col(vec), scale).alias("q")))
    rows = materialize(rows.withColumn("dim", F.size("q")), "llm-vectors")  # pins rid
    sizes = rows.agg(F.count("*"), F.sum(F.col("ask").cast("long"))).first()
    n_cand, n_query = (max(1, -(-(sizes[0] or 0) // candidate_block)), max(1, -(-(sizes[1] or 0) // query_block)))

    def dealt(df: DataFrame, kind: str, n: int) -> DataFrame:
        return (df.select("dim", F.pmod(F.xxhash64("rid"), F.lit(n)).alias("block"), F.lit(kind).alias("kind"),
                          "rid", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "q")
                .groupBy("dim", "block", "kind").applyInPandas(_pack, BLOCK))

    cand = dealt(rows, "c", n_cand).select("dim", "block", "keys", "ids", "data")
    asks = (dealt(rows.where("ask"), "q", n_query)
            .select("dim", F.col("keys").alias("qkeys"), F.col("ids").alias("qids"), F.col("data").alias("qdata"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_cand - 1).cast("long"))).alias("block")))

    def search(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lists = None, None
        for pdf in it:
            for r in pdf.itertuples(index=False):
                if last != (r.dim, r.block):
                    data = np.frombuffer(r.data, np.int64).reshape(-1, r.dim)
                    lists = Lists(data, np.frombuffer(r.ids, np.int64), np.frombuffer(r.keys, np.int64))
                    last = (r.dim, r.block)
                qkeys, qids = np.frombuffer(r.qkeys, np.int64), np.frombuffer(r.qids, np.int64)
                out = [lists.search(q, own, k) for q, own in
                       zip(np.frombuffer(r.qdata, np.int64).reshape(-1, r.dim), qkeys)]
                n = [len(p) for p, _ in out]
                found = lists.ids[np.concatenate([p for p, _ in out])]
                yield pd.DataFrame({
                    "qrid": np.repeat(qkeys, n), "query_id": with_nulls(np.repeat(qids, n)),
                    "vec_id": with_nulls(found), "score": np.concatenate([s for _, s in out])})

    found = asks.join(cand, ["dim", "block"]).mapInPandas(search, FOUND)
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

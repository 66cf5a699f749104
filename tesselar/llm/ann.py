"""Operator 9: exact nearest neighbours by a block matrix join over int8 tiles.

Queries are dealt to query blocks and candidates to candidate blocks, and blocks
meet in a join on both blocks' numbers: a task has one block of each and nothing
else. Vectors are quantised to int8, each with its own scale, and the norm of what
that loses is kept. One matrix product of the queries and a tile of candidates
gives quantised distances; by the triangle inequality the true ones lie within
the two losses. Pairs whose lower bound passes the query's k-th upper bound or its
heap's worst entry are recomputed in double precision and pushed on the query's
heap. Heaps of all tasks are merged by a ranking.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, pieces_of, small_batches, table

K = 10
EVERY = 100
#: Rows of a block of queries and of a block of candidates (on average), and least blocks of candidates.
QUERY_ROWS, CANDIDATE_ROWS, LEAST = 4096, 65536, 8
QUERIES, TILE = 1024, 4096


def usable(v: Column) -> Column:
    """Vectors that are not null, empty or zero and hold no null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 codes (held as float32, whose products and sums of up to 1,000 components are exact whole numbers), scales, norms of the quantised rows, norms of the loss."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    code = np.rint(x / scale)
    near = code * scale
    return code.astype(np.int8).astype(np.float32), scale[:, 0], np.sqrt((near * near).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, components summed in order."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        step = a[:, d] - b[:, d]
        total += step * step
    return np.sqrt(total)


class Heaps:
    """The k nearest ids of each query so far; ties go to smaller ids, and an id counts once, with its nearest vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.best: list[dict[int, float]] = [{} for _ in ids]
        self.worst = np.full(len(ids), np.inf)
        self.coded = quantise(vectors)

    def tile(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes a tile of candidates, ids ascending."""
        ids, x = self._distinct(ids, x)
        code, scale, norm, loss = quantise(x)
        heads = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # rows of one id are neighbours
        for lo in range(0, len(self.ids), QUERIES):
            part = slice(lo, lo + QUERIES)
            qc, qs, qn, ql = (c[part] for c in self.coded)
            dots = (qc @ code.T).astype(np.float64) if x.shape[1] <= 1000 else qc.astype(np.float64) @ code.T.astype(np.float64)
            d = qn[:, None] ** 2 + norm**2 - 2 * dots * (qs[:, None] * scale)
            d = np.sqrt(np.maximum(d, 0))
            slack = ql[:, None] + loss + 1e-7 * (qn[:, None] + norm)
            own = self.ids[part][:, None] == ids
            high = np.minimum.reduceat(np.where(own, np.inf, d + slack), heads, axis=1)  # of ids, not of rows
            cut = np.partition(high, self.k - 1, axis=1)[:, self.k - 1] if len(heads) > self.k else np.full(len(high), np.inf)
            near = (d - slack <= np.minimum(cut, self.worst[part])[:, None]) & ~own
            i, j = np.nonzero(near)
            for q, s, v in zip((i + lo).tolist(), distances(self.vectors[i + lo], x[j]).tolist(), ids[j].tolist(), strict=True):
                self._push(q, s, v)

    def _push(self, q: int, score: float, vec_id: int) -> None:
        heap, best = self.heaps[q], self.best[q]
        known = best.get(vec_id)
        if known is not None:
            if score >= known:
                return
            heap[heap.index((-known, -vec_id))] = (-score, -vec_id)
            heapq.heapify(heap)
        elif len(heap) < self.k:
            heapq.heappush(heap, (-score, -vec_id))
        elif (-score, -vec_id) > heap[0]:
            del best[-heapq.heapreplace(heap, (-score, -vec_id))[1]]
        else:
            return
        best[vec_id] = score
        if len(heap) == self.k:
            self.worst[q] = -heap[0][0]

    def _distinct(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ordered by id; of equal vectors the k + 1 smallest ids, each once: no query can want more of them."""
        _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).reshape(-1), return_inverse=True)
        order = np.lexsort((ids, group))
        order = order[np.flatnonzero((np.diff(group[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=ids[order[0]] - 1) != 0))]  # equal rows once
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        keep = order[place <= self.k]
        keep = keep[np.argsort(ids[keep], kind="stable")]
        return ids[keep], x[keep]


def _matrix(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows (vec_id, v) of one size, ids ascending."""
    side = side.sort_by("vec_id").combine_chunks()
    ids, lists = side["vec_id"].to_numpy(), side["v"].combine_chunks()
    return ids, lists.flatten().to_numpy().reshape(len(ids), -1)


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row of (vec_id, embedding) whose id is divisible by ``every``.

    Rows with unusable vectors (see ``usable``) or a null id take no part; vectors
    of another dimension than a query's are no candidates of it. Of repeated ids
    with different vectors the smallest vector asks, and the nearest is found, once.
    Ties go to the smaller id. Other columns are ignored; an empty table gives no rows.

    Repeated rows are one. A row's block is drawn from its id and its vector, so no
    id is hot; a task holds some ``query_rows`` queries and ``candidate_rows``
    candidates however large the table is.
    """
    ws = Workspace(rows.sparkSession, "neighbours")
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = ws.put(good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    n, m = good.count(), asked.count()
    query_blocks, blocks = pieces_of(m, query_rows), pieces_of(n, candidate_rows, LEAST)
    draw = F.xxhash64("vec_id", "v")
    left = asked.withColumn("qb", F.pmod(draw, F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = good.withColumn("cb", F.pmod(draw, F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return kinds.empty_table()
        heaps = Heaps(*_matrix(queries), k)
        ids, x = _matrix(candidates)
        for lo in range(0, len(ids), TILE):
            heaps.tile(ids[lo : lo + TILE], x[lo : lo + TILE])
        found = [(int(q), -v, -s) for q, heap in zip(heaps.ids, heaps.heaps, strict=True) for s, v in heap]
        return pa.Table.from_arrays([pa.array([r[i] for r in found], kind.type) for i, kind in enumerate(kinds)], schema=kinds)

    small_batches(rows.sparkSession)
    keys = [F.size("v").alias("width"), "qb", "cb"]
    sides = [x.select("vec_id", "v", *keys).groupBy("width", "qb", "cb") for x in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: The same by ordinary SQL, components summed in the same order.
ORACLE = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i])), lambda a, b: a + b)) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

"""Coarse cells of vectors: an optional index that lets a search read part of a table.

Cells are spherical k-means centres fitted on a bounded sample; every vector is
indexed in the cell of its nearest centre, and a table written by cell is pruned
to the cells nearest to a query. With ``probes`` = all cells the search is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, literal
from .search import top_k

CELLS, SAMPLE, ROUNDS, SEED = 16, 20_000, 10, 42


def fit(rows: DataFrame, vector: str = "vector", key: str = "chunk_id", cells: int = CELLS, sample: int = SAMPLE) -> list[list[float]]:
    """Unit centres from at most ``sample`` rows, the first by a digest of their key."""
    some = rows.where(F.col(vector).isNotNull()).orderBy(F.md5(F.col(key).cast("string")), key).limit(sample).select(F.col(vector).cast("array<double>")).collect()
    x = np.array([r[0] for r in some])
    if not len(x):
        return []
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    centres = x[np.random.default_rng(SEED).permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[near == c].sum(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres.tolist()


def assign(rows: DataFrame, centres: list[list[float]], vector: str = "vector") -> DataFrame:
    """Adds ``cell``, the number of the nearest centre; -1 for a null vector."""
    v = F.col(vector).cast("array<double>")
    near = F.array_max(F.array(*[F.struct(dot(v, literal(c)).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(centres)]))
    return rows.withColumn("cell", F.when(F.col(vector).isNull(), F.lit(-1)).otherwise(-near["i"]))


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("cell").parquet(path)


def probe(centres: list[list[float]], query: list[float], probes: int) -> list[int]:
    """The cells whose centres are nearest to a query."""
    return np.argsort(-(np.array(centres) @ np.array(query)), kind="stable")[:probes].tolist()


def search(rows: DataFrame, centres: list[list[float]], query: list[float], k: int, probes: int = 4, vector: str = "vector", key: str = "chunk_id") -> DataFrame:
    """The best k of the nearest cells; the filter on ``cell`` prunes partitions."""
    near = rows.where(F.col("cell").isin(*probe(centres, query, probes)))
    return top_k(near.withColumn("score", cosine(F.col(vector), literal(query))), k, key)

"""Vector search plans over chunk records (``schemas.RECORD``).

A query vector is a literal, so a search is filter, score, take-ordered: one pass,
no shuffle beyond the k best of each task. Ties go to the smaller chunk_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.lineage import small_batches
from ..functions.vectors import cosine_to, encode_query

# Chunk types and repositories of the special searches.
LEAN_TYPES = ("lean_class", "lean_function", "lean_constant", "lean_doc")
RUST_TYPES = ("rust_function", "rust_struct", "rust_enum", "rust_const", "rust_impl")
PQ_REPOS = ("leanSig", "leanMultisig", "multilinear-toolkit", "fiat-shamir")
EIP_FETCH = 10

#: Bytes of query vectors that are sent to every task at a time.
BLOCK = 4 << 20

HIT = ["content", "source", "fork", "section", "chunk_type", "score", "eip", "function_name", "client", "language", "chunk_id", "repo"]


def scored(rows: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    small_batches(rows.sparkSession)  # a thread that answers requests may have no active session
    return rows.withColumn("score", cosine_to(F.col(vector), query))


def of_kinds(rows: DataFrame, kinds: tuple, column: str = "chunk_type") -> DataFrame:
    """Rows of some kinds; the test reaches the scan."""
    return rows.where(F.col(column).isin(*kinds))


def top_k(rows: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    return rows.orderBy(F.desc("score"), key).limit(k)


def search(rows: DataFrame, query: list[float], limit: int = 5, where: Column | None = None, factor: int = 2, prefilter: bool = True, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The best ``limit`` rows by cosine that satisfy ``where``.

    With ``prefilter`` the filter comes first and reaches the scan. Without it the
    best ``factor`` x ``limit`` of all rows are filtered, so fewer may come back.
    """
    if where is None:
        return top_k(scored(rows, query, vector), limit, key)
    if prefilter:
        return top_k(scored(rows.where(where), query, vector), limit, key)
    return top_k(top_k(scored(rows, query, vector), factor * limit, key).where(where), limit, key)


def batch_search(rows: DataFrame, queries: DataFrame, k: int, vector: str = "vector", key: str = "chunk_id", most: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the best k rows for every row (query_id, query) of a query table.

    Queries of any number are met in blocks of about ``most`` bytes, each sent to
    the tasks of one scan; a task keeps its best k of each query. Vectors that are
    null, of another size or not finite are not found and find nothing.
    """
    numbered, held, size, found = [], [], 0, []
    for i, r in enumerate(queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toLocalIterator()):
        numbered.append((i, r["query_id"]))
        held.append((i, r["query"]))
        size += 8 * len(r["query"] or ()) + 8
        if size > most:
            found.append(_block(rows, held, k, vector, key))
            held, size = [], 0
    found += [_block(rows, held, k, vector, key)] if held or not found else []
    best = reduce(DataFrame.unionByName, found)
    names = rows.sparkSession.createDataFrame(numbered, T.StructType([T.StructField("number", T.LongType()), queries.schema["query_id"]]))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).join(names, "number").select("query_id", "rank", key, "score")


def _block(rows: DataFrame, queries: list[tuple[int, list[float] | None]], k: int, vector: str, key: str) -> DataFrame:
    """(number, key, score): each task's best k for the queries of a block. Sums are taken row by row, so equal vectors have equal scores."""
    by_width: dict[int, list[tuple[int, list[float]]]] = {}
    for i, q in queries:
        if q and all(x is not None and math.isfinite(x) for x in q):
            by_width.setdefault(len(q), []).append((i, q))
    asked = {n: (np.array([i for i, _ in qs]), np.array([q for _, q in qs], float)) for n, qs in by_width.items()}

    def keep(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).sort_by([("number", "ascending"), ("score", "descending"), (key, "ascending")])
        number = whole["number"].to_numpy()
        return whole.take(pa.array(np.flatnonzero(np.arange(len(number)) - np.searchsorted(number, number) < k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table] = []
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for width, (numbers, q) in asked.items():
                own = np.flatnonzero(lengths == width)
                x = batch.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                own, x = own[np.isfinite(x).all(axis=1)], x[np.isfinite(x).all(axis=1)]
                if not len(own):
                    continue
                sizes = np.sqrt((x * x).sum(axis=1))
                for i, one in zip(numbers.tolist(), q, strict=True):
                    scale = sizes * math.sqrt(float((one * one).sum()))
                    score = np.divide((x * one).sum(axis=1), scale, out=np.zeros(len(x)), where=scale != 0)
                    top = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                    best.append(pa.table({"number": np.full(len(top), i), key: batch.column(0).take(pa.array(own[top])), "score": score[top]}))
            if len(best) > 64:
                best = [keep(best)]
        if best:
            yield from keep(best).to_batches()

    kind = dict(rows.dtypes)[key]
    return rows.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, f"number bigint, `{key}` {kind}, score double")


def merge_legs(legs: list[DataFrame], limit: int, on: tuple[str, ...] = ("source", "section")) -> DataFrame:
    """Legs in order, each by rank; of equal (source, section) the first stays; then by score, ties by leg and rank."""
    numbered = [x.withColumn("leg", F.lit(i)).withColumn("leg_rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))) for i, x in enumerate(legs)]
    every = reduce(DataFrame.unionByName, numbered)
    first = F.row_number().over(Window.partitionBy(*on).orderBy("leg", "leg_rank"))
    return every.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("score"), "leg", "leg_rank").limit(limit)


def github_url(rows: DataFrame, repos: DataFrame) -> DataFrame:
    """Adds github_url: by the row's repo, else by the first known repository that is a component of its path; null if there is neither."""
    names = [(r["repo"], r["url"], r["branch"]) for r in repos.orderBy("ordinal").collect()]
    parts = F.split("source", "/")
    direct = F.coalesce(*[F.when(F.col("repo") == n, F.concat(F.lit(f"{u}/blob/{b}/"), F.col("source"))) for n, u, b in names])

    def below(n: str, u: str, b: str) -> Column:
        at = F.array_position(parts, n)
        rest = F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts), F.lit(1))), "/")
        return F.when((at > 0) & (at < F.size(parts)), F.concat(F.lit(f"{u}/blob/{b}/"), rest))

    return rows.withColumn("github_url", F.when(F.coalesce(F.col("source"), F.lit("")) != "", F.coalesce(direct, *[below(*x) for x in names])))


class Searcher:
    """The searches of an index; ``prefilter=False`` filters after fetching more than is asked for."""

    def __init__(self, rows: DataFrame, repos: DataFrame | None = None, model: str = "hashing", prefilter: bool = True):
        self.rows, self.repos, self.model, self.prefilter = rows, repos, model, prefilter

    def _run(self, query: str, limit: int, where: Column | None, factor: int) -> DataFrame:
        found = search(self.rows, encode_query(query, self.model), limit, where, factor, self.prefilter).select(*HIT)
        return github_url(found, self.repos) if self.repos is not None else found

    def search(self, query: str, limit: int = 5, fork: str | None = None, chunk_type: str | None = None) -> DataFrame:
        tests = [F.col(c) == v for c, v in (("fork", fork), ("chunk_type", chunk_type)) if v]
        return self._run(query, limit, reduce(lambda a, b: a & b, tests) if tests else None, 2)

    def search_constant(self, name: str) -> DataFrame:
        return self.search(f"{name} constant value", 10, chunk_type="constant")

    def search_function(self, name: str, fork: str | None = None) -> DataFrame:
        return self.search(f"def {name}", 5, fork, "function")

    def search_eip(self, query: str, number: str | None = None, limit: int = EIP_FETCH) -> DataFrame:
        """At most EIP_FETCH hits; a number is compared after they are fetched unless filters come first."""
        if number and self.prefilter:
            return self._run(query, min(limit, EIP_FETCH), (F.col("chunk_type") == "eip") & (F.col("eip") == number), 2)
        found = self.search(query, EIP_FETCH, chunk_type="eip")
        found = found.where(F.col("eip") == number) if number else found
        return top_k(found, limit)

    def search_lean(self, query: str, limit: int = 5) -> DataFrame:
        return self._run(query, limit, F.col("chunk_type").isin(*LEAN_TYPES), 3)

    def search_pq(self, query: str, limit: int = 5, repo: str | None = None) -> DataFrame:
        where = F.col("chunk_type").isin(*RUST_TYPES) & (F.col("repo") == repo if repo else F.col("repo").isin(*PQ_REPOS))
        return self._run(query, limit, where, 3)

    def search_specs(self, query: str, fork: str | None = None, limit: int = 5) -> DataFrame:
        """Hits that are no EIP."""
        return top_k(self.search(query, 2 * limit, fork).where("chunk_type <> 'eip'"), limit)

    def combined(self, query: str, fork: str, limit: int = 5, lean: bool = False) -> DataFrame:
        legs = [self.search(query, limit, fork), self.search_eip(query)] + ([self.search_lean(query, limit)] if lean else [])
        return merge_legs(legs, limit)

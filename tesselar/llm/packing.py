"""Operator 2: best-fit packing of documents into fixed-length sequences.

Bulk-synchronous best fit. Pieces are dealt to groups of bounded size that are
swept at once on the executors. In a group, a superstep has the pieces and the
gaps sorted by size and sweeps both from large to small, so that every piece meets
its successor (the smallest gap that holds it and is not taken); conflicts are
settled by rank (longer pieces first, then by rank within a length), gaps are
updated, and supersteps repeat until all pieces of the group have a place. Then the
groups are in step: sequences that are not full enough are dissolved, and all their
pieces are sorted by size over ranges of tasks. Supersteps depend on how many pieces
and gaps of each size there are, not on which: they are swept once more over these
counts, at most CAPACITY of them whatever the number of pieces, and each task finds
its pieces' places by their ranks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, pieces_of, small_batches, table
from .tokens import packed, vocabulary

CAPACITY = 4096
#: Pieces of a group: narrow rows, some 20 MB.
GROUP_ROWS = 200_000
#: Share of the capacity up to which a sequence may stay open when its group ends.
SLACK = 1 / 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
NARROW = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]


def superstep(left: np.ndarray, ranks: np.ndarray, gaps: dict[int, list[list[int]]], runs: list[tuple]) -> bool:
    """One sweep over pieces (count by length) and gaps (size: [first sequence, count] runs); every gap takes at most one piece.

    Appends (length, first rank, count, first sequence, offset) to ``runs``. Returns whether anything was placed.
    """
    capacity = len(left) - 1
    sizes = sorted(gaps, reverse=True)
    stack: list[list[int]] = []
    updated, at, placed = defaultdict(list), 0, False
    for length in np.flatnonzero(left)[::-1].tolist():
        while at < len(sizes) and sizes[at] >= length:
            stack += [[sizes[at], *run] for run in gaps[sizes[at]]]
            at += 1
        want = int(left[length])
        while want and stack:
            gap, first, count = stack[-1]
            n = min(want, count)
            runs.append((length, int(ranks[length]), n, first, capacity - gap))
            ranks[length] += n
            want -= n
            if gap > length:
                updated[gap - length].append([first, n])
            if n == count:
                stack.pop()
            else:
                stack[-1][1:] = [first + n, count - n]
            placed = True
        left[length] = want
    for gap, first, count in stack:
        updated[gap].append([first, count])
    for size in sizes[at:]:
        updated[size] += gaps[size]
    gaps.clear()
    gaps.update(updated)
    return placed


def place(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place all pieces, and the number of sequences.

    New sequences open when no piece left fits any gap: as many as the tokens
    left would fill at least.
    """
    left, ranks = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    gaps: dict[int, list[list[int]]] = {}
    runs: list[tuple] = []
    opened = 0
    while left.any():
        if not superstep(left, ranks, gaps, runs):
            n = max(1, -(-int(left @ np.arange(capacity + 1)) // capacity))
            gaps.setdefault(capacity, []).append([opened, n])
            opened += n
    return np.array(runs, np.int64).reshape(-1, 5), opened


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of a group; pieces of one length are ranked by their place."""
    sizes, counts = np.unique(lengths, return_counts=True)
    runs, _ = place(dict(zip(sizes.tolist(), counts.tolist(), strict=True)), capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    order = np.argsort(lengths, kind="stable")
    # in the order of (length, rank), the runs' pieces stand end to end
    within = np.arange(len(lengths)) - np.repeat(np.cumsum(runs[:, 2]) - runs[:, 2], runs[:, 2])
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[order], offset[order] = np.repeat(runs[:, 3], runs[:, 2]) + within, np.repeat(runs[:, 4], runs[:, 2])
    return sequence, offset


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document (doc_id, text): ids of the text, then id 1, cut at ``capacity``."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        for block, coded in packed(batches, path):
            rows: list[tuple] = []
            for doc_id, ids in zip(block.column(0).to_pylist(), coded, strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def sweep(rows: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """A round: rows (NARROW) with sequence_id (below 0 for none yet), offset and used, packed in ``groups`` groups of their own.

    sequence_id has the round, the group and the group's sequence; used is how full the sequence is.
    """
    kinds = [pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64()), pa.field("used", pa.int64())]

    def pack(group: pa.Table) -> pa.Table:
        mine = group["group"][0].as_py()
        group = group.select(NARROW).sort_by("uid")
        lengths = group["length"].to_numpy()
        sequence, offset = best_fit(lengths, capacity)
        used = np.bincount(sequence, lengths).astype(np.int64)
        for kind, values in zip(kinds, ((number << 56) + (mine << 24) + sequence, offset, used[sequence]), strict=True):
            group = group.append_column(kind, pa.array(values))
        return group

    dealt = rows.select(*NARROW, F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)).alias("group"))
    # few bytes, much work: not to be coalesced
    return dealt.repartition(min(groups, 1 << 15), "group").groupBy("group").applyInArrow(pack, "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, used bigint")


def settle(left: DataFrame, ws: Workspace, number: int, capacity: int) -> DataFrame:
    """Places for rows (NARROW) of any number: range-sorted by size, swept by counts of sizes, found again by rank.

    The driver sees a count for each size and task, and runs of equal pieces in equal gaps.
    """
    kinds = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def rank(batches):
        task, held, last = TaskContext.get().partitionId(), 0, -1
        for batch in batches:
            lengths = batch.column(4).to_numpy()
            first = np.searchsorted(lengths, lengths)  # lengths ascend
            ranks = np.arange(len(lengths)) - first
            ranks[lengths == last] += held
            if len(lengths):
                held, last = int(ranks[-1]) + 1, int(lengths[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), task)), pa.array(ranks)], schema=pa.schema([*kinds, ("part", pa.int64()), ("rank", pa.int64())]))

    schema = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    ordered = left.select(NARROW).repartitionByRange("length", "uid").sortWithinPartitions("length", "uid").mapInArrow(rank, f"{schema}, part bigint, rank bigint")
    ordered = ws.put(ordered, f"ordered-{number}")
    counts = ordered.groupBy("length", "part").count().orderBy("length", "part").toArrow()
    length, n = counts["length"].to_numpy(), counts["count"].to_numpy()
    before = np.cumsum(n) - n
    before -= before[np.searchsorted(length, length)]  # of the same length in earlier tasks
    keys = length * (1 << 32) + counts["part"].to_numpy()
    sizes, at = np.unique(length, return_index=True)
    runs, _ = place(dict(zip(sizes.tolist(), np.add.reduceat(n, at).tolist() if len(n) else [], strict=True)), capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    edges = runs[:, 0] * (1 << 48) + runs[:, 1]

    def find(batches):
        for batch in batches:
            size, part = batch.column(4).to_numpy(), batch.column(6).to_numpy()
            ranks = batch.column(7).to_numpy() + before[np.searchsorted(keys, size * (1 << 32) + part)]
            run = runs[np.searchsorted(edges, size * (1 << 48) + ranks, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array((number << 56) + run[:, 3] + ranks - run[:, 1]), pa.array(run[:, 4])], schema=pa.schema([*kinds, ("sequence_id", pa.int64()), ("offset", pa.int64())]))

    return ordered.mapInArrow(find, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A place for every piece of documents (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text counts as empty and has one piece, the end id; texts of any length
    are cut only at ``capacity``. Repeated rows, equal lengths and null ids are
    documents like any other; other columns are ignored; an empty table gives no
    rows. Pieces of full length are sequences of their own, with negative numbers.
    Only narrow rows are dealt to groups; ids join their places at the end.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.put(token_pieces(docs, path, capacity, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    out = pieces.where(F.col("length") == capacity).select(*NARROW, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = pieces.where(F.col("length") < capacity).select(*NARROW)
    groups = pieces_of(left.count(), group_rows)
    first = ws.put(sweep(left, groups, 0, capacity), "groups")
    if groups > 1:
        full = F.col("used") >= capacity * (1 - SLACK)
        out = out.unionByName(first.where(full).drop("used")).unionByName(settle(first.where(~full), ws, 1, capacity))
    else:
        out = out.unionByName(first.drop("used"))
    if keep_ids:
        out = out.select("uid", "sequence_id", "offset").join(pieces, "uid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())

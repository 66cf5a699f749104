"""Operator 3: SimHash near-duplicates by a binary trie self-join.

Sorted distinct fingerprints are a binary trie (a node is a run with equal first
bits). Node pairs are walked together: a pair carries the bits in which its
prefixes differ and is dropped once they exceed the budget. Pairs that survive are
compared in full; the links found make a local union, of which only a spanning
forest leaves the task. Forests of all tasks are joined into components.

The trie is dealt to tasks by its first levels. Bits are cut into more blocks than
the budget, so two fingerprints within it agree in some blocks entirely; for each
choice of such blocks these come first in the bits' order, and only subtrees that
agree in them can hold a link. So a fingerprint goes out once for each choice (five
times up to some 9 billion fingerprints), not once for each part of the corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import Workspace, blocks, components, give_back, pieces_of, small_batches, table, text_bytes, word_spans

SHINGLE = 4
ERRORS = 4
SEED = 42
#: Fingerprints of a task, and of a subtree from which on it is split.
RANGE_ROWS = 1 << 20
#: Node pairs walked at once, and fingerprint pairs up to which two nodes are compared in full.
CHUNK, PAIRS = 1 << 17, 32


def fingerprints(raw: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text, as signed integers; texts without words have 0."""
    from xxhash import xxh64_intdigest

    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    starts, stops, at = word_spans(raw, ends)
    data = raw.tobytes()
    joined = b" ".join([data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    to = np.cumsum(stops - starts + 1) - 1
    begin = to - (stops - starts)
    n = np.diff(at)
    grams = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.repeat(at[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    last = first + np.minimum(np.repeat(n, grams), shingle) - 1
    hashed = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), to[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(grams)
    if len(full):
        bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, (np.cumsum(grams) - grams)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > grams[full][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs (text, other columns stay) with the SimHash of the whole text as bigint ``name``; null counts as empty."""
    small_batches(docs.sparkSession)

    def add(batches):
        for block in blocks(batches):
            raw, ends = text_bytes(block.column(block.schema.get_field_index("text")))
            yield block.append_column(name, pa.array(fingerprints(raw, ends)))
        give_back()

    return docs.mapInArrow(add, StructType([*docs.schema.fields]).add(name, LongType()))


class Trie:
    """Binary trie over sorted distinct unsigned fingerprints; level d holds runs with equal first d bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.lo, self.hi = [np.zeros(1, np.int64)], [np.full(1, len(values), np.int64)]
        self.children: list[np.ndarray] = []

    def split(self, depth: int) -> np.ndarray:
        """Children of the nodes at a level: (n, 2) numbers in the next level, -1 for none."""
        if depth == len(self.children):
            lo, hi, bit = self.lo[depth], self.hi[depth], np.uint64(63 - depth)
            mid = np.searchsorted(self.values, ((self.values[lo] >> bit) | np.uint64(1)) << bit)
            mid = np.clip(mid, lo, hi)
            left, right = mid > lo, hi > mid
            n = np.cumsum(np.column_stack([left, right]).reshape(-1)).reshape(-1, 2) - 1
            self.children.append(np.where(np.column_stack([left, right]), n, -1))
            keep = np.column_stack([left, right]).reshape(-1)
            self.lo.append(np.column_stack([lo, mid]).reshape(-1)[keep])
            self.hi.append(np.column_stack([mid, hi]).reshape(-1)[keep])
        return self.children[depth]


def close_pairs(a: np.ndarray, b: np.ndarray | None, errors: int = ERRORS, equal: int = 0):
    """Yields arrays (i, j): all places with at most ``errors`` differing bits between sorted a and b (b None: i < j within a).

    Of pairs that differ in the first ``equal`` bits only some are found.
    """
    one = b is None
    ta = Trie(a)
    tb = ta if one else Trie(b)
    if not len(a) or not len(tb.values):
        return
    stack = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while stack:
        depth, p, q, e = stack.pop()
        na, nb = ta.hi[depth][p] - ta.lo[depth][p], tb.hi[depth][q] - tb.lo[depth][q]
        done = (na * nb <= PAIRS) | (depth == 64)
        if done.any():
            yield from _compare(ta, tb, one, depth, p[done], q[done], errors)
            p, q, e = p[~done], q[~done], e[~done]
        if not len(p):
            continue
        ca = ta.split(depth)
        cb = ca if one else tb.split(depth)
        found = []
        for x in (0, 1):
            for y in (0, 1):
                u, v = ca[p, x], cb[q, y]
                if x != y and depth < equal:
                    continue
                keep = (u >= 0) & (v >= 0) & (e + (x != y) <= errors)
                if one and x > y:
                    keep &= p != q
                found.append((u[keep].astype(np.int32), v[keep].astype(np.int32), (e[keep] + (x != y)).astype(np.int8)))
        p, q, e = (np.concatenate(c) for c in zip(*found, strict=True))
        stack += [(depth + 1, p[i : i + CHUNK], q[i : i + CHUNK], e[i : i + CHUNK]) for i in range(0, len(p), CHUNK)]


def _compare(ta: Trie, tb: Trie, one: bool, depth: int, p: np.ndarray, q: np.ndarray, errors: int):
    la, lb = ta.lo[depth][p], tb.lo[depth][q]
    nb = tb.hi[depth][q] - lb
    n = (ta.hi[depth][p] - la) * nb
    which = np.repeat(np.arange(len(p)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    i, j = la[which] + k // nb[which], lb[which] + k % nb[which]
    keep = np.bitwise_count(ta.values[i] ^ tb.values[j]) <= errors
    if one:
        keep &= i < j
    if keep.any():
        yield i[keep], j[keep]


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; every entry of ``parent`` points at its set's smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def forest(a: np.ndarray, b: np.ndarray | None, errors: int = ERRORS, equal: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) that join what ``close_pairs`` links, fewer than there are values."""
    values = a if b is None else np.concatenate([a, b])
    parent, shift = np.arange(len(values)), 0 if b is None else len(a)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for i, j in close_pairs(a, b, errors, equal):
        held.append((i, j + shift))
        n += len(i)
        if n >= len(values):  # a union passes over all values, so it waits for as many links
            union(parent, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        union(parent, *(np.concatenate(x) for x in zip(*held, strict=True)))
    own = np.flatnonzero(parent != np.arange(len(values)))
    return values[own], values[parent[own]]


def layouts(n: int, errors: int = ERRORS, rows: int = RANGE_ROWS) -> list[tuple[list[tuple[int, int]], int]]:
    """Orders of the 64 bits as (lowest bit, width) of blocks, and how many first bits two close fingerprints share in one of them.

    There are as few blocks as leave a task's worth of n evenly spread fingerprints to a value of the first bits.
    """
    m = errors + 1
    while m < errors + 4 and n >> (64 * (m - errors) // m) > rows:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for front in combinations(range(m), m - errors):
        order = [parts[i] for i in front] + [parts[i] for i in range(m) if i not in front]
        out.append((order, sum(parts[i][1] for i in front)))
    return out


def front_bits(fp: Column, order: list[tuple[int, int]], width: int) -> Column:
    """The first ``width`` bits in an order, as a number."""
    out, left = F.lit(0).cast("bigint"), width
    for low, size in order:
        if left <= 0:
            break
        left -= size
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")), left))
    return out


def reorder(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(values), np.uint64), 64
    for low, size in order:
        at -= size
        out |= ((values >> np.uint64(low)) & np.uint64((1 << size) - 1)) << np.uint64(at)
    return out


def restore(values: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, at = np.zeros(len(values), np.uint64), 64
    for low, size in order:
        at -= size
        out |= ((values >> np.uint64(at)) & np.uint64((1 << size) - 1)) << np.uint64(low)
    return out


def deal(fps: DataFrame, chosen: list[tuple[list[tuple[int, int]], int]], n: int, rows: int = RANGE_ROWS) -> DataFrame:
    """fp, layout, front (value of the first bits), lo, hi, own: subtrees to walk.

    A subtree of more than ``rows`` fingerprints is cut into chunks by a hash, and
    chunks meet two by two (lo, hi); ``own`` is the row's chunk. All others have 0.
    """
    fronts = F.array(*[F.struct(F.lit(i).alias("layout"), front_bits(F.col("fp"), order, width).alias("front")) for i, (order, width) in enumerate(chosen)])
    dealt = fps.select("fp", F.explode(fronts).alias("_f")).select("fp", "_f.layout", "_f.front")
    if n <= rows:
        return dealt.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("own", F.lit(0))
    hot = dealt.groupBy("layout", "front").agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    hot = hot.select("layout", "front", F.ceil(F.col("_n") / rows).cast("int").alias("_k"))
    # at most one row for each `rows` rows of dealt
    dealt = dealt.join(F.broadcast(hot), ["layout", "front"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return dealt.select("fp", "layout", "front", F.least("own", "_o").alias("lo"), F.greatest("own", "_o").alias("hi"), "own")


def link(ws: Workspace, fps: DataFrame, errors: int = ERRORS, rows: int = RANGE_ROWS) -> DataFrame:
    """(fp, root) for distinct fingerprints (fp bigint): root is the same for all that links connect."""
    n = fps.count()
    chosen = layouts(n, errors, rows)
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def walk(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held)
        fp, layout, lo, hi, own = (part[c].to_numpy() for c in ("fp", "layout", "lo", "hi", "own"))
        keys, which = np.unique(np.stack([layout, lo, hi]), axis=1, return_inverse=True)
        for g, (at, low, high) in enumerate(keys.T.tolist()):
            order, width = chosen[at]
            mine = np.flatnonzero(which.reshape(-1) == g)
            values = reorder(fp[mine].view(np.uint64), order)
            sides = [np.sort(values)] if low == high else [np.sort(values[own[mine] == x]) for x in (low, high)]
            a, b = forest(sides[0], None if low == high else sides[1], errors, width)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(restore(x, order).view(np.int64)) for x in (a, b)], schema=kinds)
        give_back()

    small_batches(fps.sparkSession)
    # a set number of tasks, each with whole subtrees; few bytes, much work: not to be coalesced
    dealt = deal(fps, chosen, n, rows).repartition(max(8, pieces_of(n * len(chosen), rows)), "layout", "front", "lo", "hi")
    rooted = components(ws, dealt.drop("front").mapInArrow(walk, "a bigint, b bigint"))
    return fps.join(rooted, fps["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(ws: Workspace, printed: DataFrame, errors: int = ERRORS) -> DataFrame:
    """(fp, rep struct<none, doc_id, fp>) from (doc_id, fp): the smallest doc_id of each component (null: last)."""
    least = ws.put(printed.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least")), "least")
    rooted = ws.put(link(ws, least.select("fp"), errors), "rooted")
    # a table of its own, so that a root of very many fingerprints can be split in the join
    reps = ws.put(rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("rep")), "reps-of-roots")
    return rooted.join(reps, "root").select("fp", "rep")


def near_duplicates(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents (doc_id, text).

    A null text counts as empty; texts without words have fingerprint zero, linked
    like any other. Null ids never name a component that has another id. Repeated
    rows give a row each, texts are read whole, other columns are ignored; an empty
    table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    printed = ws.put(with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "fp"), "printed")
    found = ws.put(groups(ws, printed, errors), "groups")
    ws.keep("printed", "groups")
    return printed.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """The documents with the smallest doc_id of each component, with the columns of docs; one of repeated rows stays."""
    columns = docs.columns
    ws = Workspace(docs.sparkSession, "simhash-keep")
    rows = docs.select(F.struct(*[c for c in columns if c != "text"]).alias("_row"), "text", F.col("doc_id").cast("bigint").alias("_id"))
    printed = ws.put(with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select("doc_id", "fp"), "printed")
    reps = groups(ws, printed, errors).select("rep").distinct().select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.fp").alias("rep_fp"))
    reps = ws.put(reps, "reps")
    ids = reps.where("rep_id is not null")
    kept = rows.join(ids.select("rep_id").distinct(), F.col("_id") == F.col("rep_id"), "left_semi").unionByName(rows.where("_id is null"))
    kept = with_fingerprint(kept, "_fp").join(reps, F.col("_id").eqNullSafe(F.col("rep_id")) & (F.col("_fp") == F.col("rep_fp")), "left_semi")
    return kept.dropDuplicates(["_id", "_fp"]).select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

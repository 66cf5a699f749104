"""Operator 13: the prefix trie of conversations, as a Cartesian tree over sorted conversations.

A turn is a 128-bit digest of its role and text, a conversation the string of its
turns' digests. ``sequences`` are range-sorted, so a trie node is an interval of
neighbours whose common prefixes (LCP) are all as long as its depth: the interval
between the nearest smaller LCP values on its left and right. A task finds these for
its block with a stack; what its own minima leave open on one side, the values
smaller than all before or all after them, is its summary: one entry for a distinct
minimum. Summaries are swept alike, FAN blocks at a time, until one is left. Nodes
of one LCP value merge on the stack, and a closed node is expanded to all depths
between its parent's and its own, with what its interval sums to.

A row with a null conv_id takes no part; equal (conv_id, turn) go by the digest of
role and text, repeated rows are turns of their own; a null role or text is empty;
other columns are ignored; an empty table has no node. A conversation's digests and
word counts, 20 bytes a turn, must fit a row; its texts need not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, give_back, sent, small_batches, table, whole_groups, words

#: Bytes of a turn's digest and of its word count.
TURN = 16
COUNT = 4
#: Summaries of blocks that one task sweeps.
FAN = 64
#: Rows that wait for their parent on the stack of a task before they are joined with it instead.
WAITING = 10_000
#: Ids in a row of an open node's ends.
IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, ends_key binary"
ENDS = "part bigint, number bigint, ids array<bigint>"
SUMMARY = "block bigint, first binary, first_words binary, last binary, last_words binary, spine array<struct<depth: bigint, n: bigint, low: bigint, leaves: bigint, children: bigint, saved: bigint, ends: boolean>>"
FOUND = f"{NODES}, {ENDS}, {SUMMARY}"


def sequences(turns: DataFrame, ws: Workspace, name: str = "own") -> DataFrame:
    """conv_id, seq (digests of its turns, in order) and words (counts of 4 bytes) of each conversation of (conv_id, turn, role, text), written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(digest, 1, TURN).alias("digest"), F.size(words(text)).alias("n"))
    rows = ws.put(rows, f"{name}-turns")

    def join(batches):
        part = TaskContext.get().partitionId()
        for group, cuts in whole_groups(batches, ["conv_id"], 1 << 14):
            digests, n = b"".join(group["digest"].to_pylist()), group["n"].to_numpy().astype("<i4").tobytes()
            ends = zip(cuts, cuts[1:], strict=False)
            made = [(digests[TURN * a : TURN * b], n[COUNT * a : COUNT * b]) for a, b in ends]
            ids = group["conv_id"].combine_chunks().take(pa.array(cuts[:-1]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([part] * len(ids), pa.int64()), pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())], names=["conv_id", "part", "seq", "words"])

    small_batches(turns.sparkSession)
    ordered = rows.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    pieces = ordered.select("conv_id", "digest", "n").mapInArrow(join, "conv_id bigint, part bigint, seq binary, words binary")
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "words"))).alias("p"))  # a piece for each task that has some of its turns
    glue = lambda c: F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x[c]))
    out = ws.put(whole.select("conv_id", glue("seq").alias("seq"), glue("words").alias("words")), name)
    ws.drop(f"{name}-turns")
    return out


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 20, h = crc32(c) % 4."""
    heads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.substring("seq", 1, 3 * TURN).alias("head"), F.substring("words", 1, 3 * COUNT).alias("head_words"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.withColumn("h", h).join(heads, F.col("base") == F.col("conv_id") - F.col("conv_id") % 20, "left")

    def swap(mine, theirs, size):
        rest = F.substring(F.col(mine), F.col("h") * size + 1, F.length(mine) + 1)
        return F.concat(F.coalesce(F.substring(F.col(theirs), F.lit(1), F.col("h") * size), F.lit(b"")), rest).alias(mine)

    return both.select("conv_id", swap("seq", "head", TURN), swap("words", "head_words", COUNT))


def common(a: bytes, b: bytes) -> int:
    """Turns at the start that two sequences share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def key_of(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * TURN]).digest()[:TURN]


class Node:
    """What is known of an interval so far: members, smallest of them, and sums over its closed children."""

    __slots__ = ("depth", "n", "low", "leaves", "children", "saved", "ids", "ends", "waiting", "keyed")

    def __init__(self, depth: int, n: int = 0, low: int | None = None, leaves: int = 0, children: int = 0, saved: int = 0, ends: bool = False, ids: list[int] | None = None):
        self.depth, self.n, self.low, self.leaves, self.children, self.saved, self.ends = depth, n, low, leaves, children, saved, ends
        self.ids, self.waiting, self.keyed = ids or [], [], False

    def add(self, n, low, leaves, children, saved):
        self.n += n
        if low is not None:
            self.low = low if self.low is None else min(self.low, low)
        self.leaves += leaves
        self.children += children
        self.saved += saved


class Sweep:
    """Nearest smaller values of a run of LCPs: ``stack`` holds nodes open on the right, ``left`` those closed on the right only.

    With ``root`` the run is the whole table, and nothing is open on its left.
    """

    def __init__(self, root: bool, upper: bool, waiting: int = WAITING, ids: int = IDS):
        self.stack, self.left, self.upper, self.most, self.ids = [Node(0)] if root else [], [], upper, waiting, ids
        self.rows: list[tuple] = []
        self.ends: list[tuple] = []

    def step(self, lcp: int, node: Node, path: bytes, counts: bytes) -> None:
        """The next leaf or entry of a summary, with ``lcp`` turns in common with the one before, whose turns and word counts are given."""
        if not self.stack:
            self.stack.append(node)
            return
        while self.stack[-1].depth > lcp:
            done = self.stack.pop()
            if not self.stack:
                self.put_off(done, path)
                self.left.append(done)
                self.stack.append(Node(lcp))
                break
            if self.stack[-1].depth < lcp:
                self.stack.append(Node(lcp))
            self.close(done, path, counts)
        top = self.stack[-1]
        if top.depth == node.depth:
            top.add(node.n, node.low, node.leaves, node.children, node.saved)
            top.ids += node.ids
            top.ends |= node.ends
        else:
            self.stack.append(node)

    def close(self, done: Node, path: bytes, counts: bytes) -> None:
        """Rows of a node that is closed on both sides, one for each depth below its parent, the stack's top."""
        parent = self.stack[-1] if self.stack else None
        above = parent.depth if parent else -1
        key = key_of(path, done.depth) if self.upper or done.keyed else None
        ends = hashlib.sha256(",".join(map(str, done.ids)).encode()).hexdigest() if done.ids else EMPTY
        self.rows += [(*r[:2], done.low, *r[3:]) for r in done.waiting]
        leaves, saved = done.leaves if done.children else 1, done.saved
        n_words = np.frombuffer(counts[COUNT * max(above, 0) : COUNT * done.depth], "<i4").tolist()
        for depth in range(done.depth, above, -1):
            last = depth == done.depth
            if depth:
                saved += (done.n - 1) * n_words[depth - above - 1]
            row = (done.low, depth, done.low if depth > above + 1 else None, None, done.n, done.children if last else 1, leaves, saved, ends if last else EMPTY, key if last else None, key_of(path, depth) if last and done.ends else None)
            if depth > above + 1 or parent is None:
                self.rows.append(row)
            else:
                parent.waiting.append(row)
        if parent:
            parent.add(done.n, done.low, leaves, 1, saved)
            if len(parent.waiting) > self.most:
                self.join_later(parent, path)

    def join_later(self, node: Node, path: bytes) -> None:
        key = key_of(path, node.depth)
        self.rows += [(*r[:3], key, *r[4:]) for r in node.waiting]
        node.waiting, node.keyed = [], True

    def put_off(self, node: Node, path: bytes) -> None:
        """An open node's rows and ends go out by its key; its sums go on in the summary."""
        self.join_later(node, path)
        for i in range(0, len(node.ids), self.ids):
            self.ends.append((key_of(path, node.depth), node.ids[i : i + self.ids]))
        node.ends |= bool(node.ids)
        node.ids = []

    def finish(self, path: bytes, counts: bytes) -> None:
        """The end of the table: all is closed."""
        while self.stack:
            self.close(self.stack.pop(), path, counts)

    def summary(self, path: bytes) -> list[dict]:
        for node in self.stack:
            self.put_off(node, path)
        return [{"depth": x.depth, "n": x.n, "low": x.low, "leaves": x.leaves, "children": x.children, "saved": x.saved, "ends": x.ends} for x in [*self.left, *self.stack]]


def _kinds() -> pa.Schema:
    long, entry = pa.int64(), pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("saved", pa.int64()), ("ends", pa.bool_())])
    node = [("conv_id", long), ("depth", long), ("parent_conv_id", long), ("parent_key", pa.binary()), ("n_convs", long), ("n_children", long), ("n_leaves", long), ("saved_tokens", long), ("ends_sha256", pa.string()), ("key", pa.binary()), ("ends_key", pa.binary())]
    return pa.schema([*node, ("part", long), ("number", long), ("ids", pa.list_(long)), ("block", long), ("first", pa.binary()), ("first_words", pa.binary()), ("last", pa.binary()), ("last_words", pa.binary()), ("spine", pa.list_(entry))])


def _batch(**columns) -> pa.RecordBatch:
    kinds = _kinds()
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)


def _rows(sweep: Sweep, part: int, number: int):
    if sweep.rows:
        names = _kinds().names[:11]
        yield _batch(**dict(zip(names, map(list, zip(*sweep.rows, strict=True)), strict=True)))
        sweep.rows = []
    if sweep.ends:
        yield _batch(key=[k for k, _ in sweep.ends], part=[part] * len(sweep.ends), number=list(range(number, number + len(sweep.ends))), ids=[x for _, x in sweep.ends])


def block_trees(ordered: DataFrame) -> DataFrame:
    """Closed nodes, ends of open ones and the summary of each task's block of sorted (conv_id, seq, words)."""

    sizes = WAITING, IDS

    def read(batches):
        block, sweep, number = TaskContext.get().partitionId(), Sweep(False, False, *sizes), 0
        first = last = None
        for batch in batches:
            for conv, seq, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                node = Node(len(seq) // TURN, 1, conv, ids=[conv])
                if last is None:
                    first = (seq, counts)
                    sweep.step(0, node, b"", b"")
                else:
                    sweep.step(common(last[0], seq), node, *last)
                last = (seq, counts)
            yield from _rows(sweep, block, number)
            number, sweep.ends = number + len(sweep.ends), []
        if last is not None:
            spine = sweep.summary(last[0])
            yield from _rows(sweep, block, number)
            yield _batch(block=[block], first=[first[0]], first_words=[first[1]], last=[last[0]], last_words=[last[1]], spine=[spine])
        give_back()

    return ordered.select("conv_id", "seq", "words").mapInArrow(read, FOUND)


def merged(summaries: DataFrame, fan: int, whole: bool) -> DataFrame:
    """Closed nodes and one summary for every ``fan`` neighbouring blocks; ``whole`` says that these are all."""

    sizes = WAITING, IDS

    def join(group: pa.Table) -> pa.Table:
        sweep, last = Sweep(whole, True, *sizes), None
        blocks = group.sort_by("block").to_pylist()
        for b in blocks:
            path = last or (b"", b"")
            lcp = common(path[0], b["first"])
            for i, x in enumerate(b["spine"]):
                if i:
                    lcp, path = min(b["spine"][i - 1]["depth"], x["depth"]), (b["first"], b["first_words"])
                sweep.step(lcp, Node(**x), *path)
            last = (b["last"], b["last_words"])
        if whole:
            sweep.finish(*last)
        spine = None if whole else sweep.summary(last[0])
        out = list(_rows(sweep, 0, 0))
        if not whole:
            a = blocks[0]
            out.append(_batch(block=[a["block"] // fan], first=[a["first"]], first_words=[a["first_words"]], last=[last[0]], last_words=[last[1]], spine=[spine]))
        return pa.Table.from_batches(out, schema=_kinds())

    return summaries.withColumn("group", F.floor(F.col("block") / fan)).groupBy("group").applyInArrow(lambda t: join(t.drop_columns(["group"])), FOUND)


def _ends(parts: DataFrame) -> DataFrame:
    """ends_key and the SHA-256 of its ids, which lie in ascending runs of several tasks."""

    def read(batches):
        key = state = None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = ",".join(map(str, ids.values.to_numpy().tolist())).encode()
                if k == key:
                    state.update(b"," + text)
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["ends_key", "sha"])
                key, state = k, hashlib.sha256(text)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["ends_key", "sha"])

    ordered = parts.repartition("key").sortWithinPartitions("key", "part", "number").select("key", "ids")
    return ordered.mapInArrow(read, "ends_key binary, sha string")


def trie(conversations: DataFrame, ws: Workspace, fan: int = FAN) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of (conv_id, seq, words)."""
    if fan < 2:
        raise ValueError(f"fan must be at least 2, got {fan}")
    small_batches(ws.spark)
    stored = ws.put(conversations, "rebuilt")
    ordered = stored.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    level, made = 0, [ws.put(block_trees(ordered), "level0")]
    while True:
        left = made[-1].where("block is not null")
        most = left.agg(F.max("block")).first()[0]  # blocks are numbered from 0
        if most is None:
            break
        level += 1
        made.append(ws.put(merged(left, fan, most < fan), f"level{level}"))
        if most < fan:
            break
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    nodes = out.where("conv_id is not null")
    parents = sent(nodes.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found")))
    ends = sent(_ends(out.where("ids is not null")))
    put_off = F.col("parent_key").isNotNull() | F.col("ends_key").isNotNull()
    late = nodes.where(put_off).join(parents, "parent_key", "left").join(ends, "ends_key", "left")
    late = late.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found")).withColumn("ends_sha256", F.coalesce("sha", "ends_sha256"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return nodes.where(~put_off).select(columns).unionByName(late.select(columns))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    ws = Workspace(spark, "prefixes")
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"), ws)), ws)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM t)
), h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM c),
r AS (
  SELECT h.conv_id, d, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 WHERE d <= h
  UNION ALL
  SELECT h.conv_id, least(h, coalesce(m, 0)) + t.d - h, role, text FROM h JOIN t ON t.conv_id = h.conv_id LEFT JOIN (SELECT conv_id, max(d) AS m FROM t GROUP BY 1) b ON b.conv_id = h.conv_id - h.conv_id % 20 WHERE t.d > h
), p AS (
  SELECT conv_id, d, string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY conv_id ORDER BY d) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM h
), q AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (
  SELECT path, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM q GROUP BY 1, 2
), k AS (SELECT up AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (path)),
sub AS (
  SELECT a.path, CAST(sum((x.n - 1) * x.w) AS BIGINT) AS saved, count(*) FILTER (WHERE x.children = 0) AS leaves
  FROM full_ x JOIN (SELECT DISTINCT n2.path AS leafpath, q2.path AS path FROM n n2 JOIN q q2 ON q2.conv_id = n2.conv_id AND q2.d <= n2.d) a ON a.leafpath = x.path GROUP BY 1
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN n p ON p.path = f.up AND f.d > 0
"""

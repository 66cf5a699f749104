"""Which contents hold a name: positional postings of three-byte grams, kept with the commits of a chunk table.

Contents in lower case are laid end to end in segments of about SEGMENT bytes, two
zero bytes after each. ``postings/commit=N`` has, for the rows that commit N brought,
a row for each segment: which contents stand where, and the ascending positions of
each gram, dealt to PARTS columns by the gram's first two bytes. A segment is whole in
its row, so neither writing nor looking up moves postings between tasks, and a
look-up reads the columns of its grams only; ``places/commit=N`` says which row stands
where. A name's grams at every third byte and at its end cover all its bytes,
and no content is read: names make a trie of grams, and the places of a segment go
down it together, all names at once, so a segment takes time for its places and what
is found there, not for each name. A name of one or two bytes is the lists of all
grams that begin with it. An empty name is held by every content that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions.lineage import small_batches
from .store import ChunkTable, Commits

SEGMENT = 4 << 20
#: Columns that a segment's grams are dealt to.
PARTS = 64
#: Rows of an index up to which their numbers, by segment, go to all tasks; of more, postings and numbers meet in a shuffle.
SENT = 1 << 23
#: A row of postings is some megabytes: the writer looks at the size of what it holds every few rows, and row groups are small. They are zstandard's, which names and gaps take less of.
WRITTEN = {"parquet.page.size.row.check.min": "4", "parquet.block.size": str(32 << 20), "compression": "zstd"}
#: Bytes of names that are looked up at a time.
BLOCK = 1 << 20
#: First grams, and positions, of names that are looked at together.
WALKED, PLACES_AT_ONCE = 1 << 16, 1 << 18
#: Ids, or grams, up to which rows are fetched by a filter that reaches the scan.
FETCHED = 1000
PLACE = 32
#: Rows that a look-up hands on at a time.
ROWS = 1 << 14

PART = [f"p{i:02}" for i in range(PARTS)]
POSTINGS = T.StructType([T.StructField("segment", T.LongType()), T.StructField("at", T.ArrayType(T.LongType())), T.StructField("length", T.ArrayType(T.LongType())), T.StructField("chunk_id", T.ArrayType(T.StringType())), *[T.StructField(p, T.BinaryType()) for p in PART]])
PLACES = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("length", T.LongType()), T.StructField("chunk_id", T.StringType())])


def _part(gram):
    """The column of a gram; those of equal first two bytes are together."""
    return ((gram >> 8) * 40503 & 0xFFFF) * PARTS >> 16


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            held.append(batch.slice(i, 64))
            size += held[-1].column(1).nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts with two zeros after each, where each begins, and its length."""
    raw, ends = N.raw_bytes(column)
    n = np.diff(ends)
    at = ends[:-1] + 2 * np.arange(len(n))
    out = np.zeros(len(raw) + 2 * len(n), np.uint8)
    out[np.arange(len(raw)) + 2 * np.repeat(np.arange(len(n)), n)] = raw
    return out, at, n


def _packed(gram: np.ndarray, n: np.ndarray, data: np.ndarray) -> bytes:
    """A column of a segment: how many grams, which, how many positions of each, and these as steps."""
    return b"".join([len(gram).to_bytes(4, "little"), gram.astype("<i4").tobytes(), n.astype("<i4").tobytes(), data.tobytes()])


def _unpacked(values: list[bytes], asked: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The sorted (gram, position) of grams that are ``asked`` for or lie in ``ranges``, from columns of a segment."""
    m = [int.from_bytes(x[:4], "little") for x in values]
    gram = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, "<i4", k, 4) for x, k in zip(values, m, strict=True)]]).astype(np.int64)
    n = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, "<i4", k, 4 + 4 * k) for x, k in zip(values, m, strict=True)]]).astype(np.int64)
    data = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(x, np.uint8, offset=4 + 8 * k) for x, k in zip(values, m, strict=True)]])
    wanted = np.isin(gram, asked)
    for g, h in ranges:
        wanted |= (gram >= g) & (gram <= h)
    place = N.sums(N.unpack(data), np.concatenate([[0], np.cumsum(n)]))
    return np.sort(np.repeat(gram[wanted], n[wanted]) << PLACE | place[np.repeat(wanted, n)])


def postings(rows: DataFrame) -> DataFrame:
    """An index (``POSTINGS``) of (chunk_id, content), a row for each segment. Rows with a null content are left out."""

    most = SEGMENT
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for table in _segments(batches, most):
            segment = (task << 32) | number
            number += 1
            data, at, n = _laid(table["content"].chunk(0) if table["content"].num_chunks else pa.array([], pa.string()))
            wide = data.astype(np.uint64)
            inside = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = np.sort(((wide[inside] << np.uint64(16) | wide[inside + 1] << np.uint64(8) | wide[inside + 2]) << np.uint64(PLACE)) | inside.astype(np.uint64))
            gram, place = (key >> np.uint64(PLACE)).astype(np.int64), (key & np.uint64((1 << PLACE) - 1)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(gram, prepend=-1)), len(gram))
            packed, to = N.pack(N.steps(place, cuts)) if len(gram) else (np.empty(0, np.uint8), np.zeros(1, np.int64))
            own, size = gram[cuts[:-1]], np.diff(cuts)
            part, found = _part(own), []
            for p in range(PARTS):
                mine = np.flatnonzero(part == p)
                lists = [packed[to[cuts[i]] : to[cuts[i + 1]]] for i in mine.tolist()]
                found.append(pa.array([_packed(own[mine], size[mine], np.concatenate([packed[:0], *lists]))], pa.binary()))
            listed = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in (pa.array(at), pa.array(n), table["chunk_id"].combine_chunks())]
            yield pa.RecordBatch.from_arrays([pa.array([segment]), *listed, *found], names=POSTINGS.fieldNames())

    lowered = rows.where("content is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lower("content").alias("content"))
    return lowered.mapInArrow(run, POSTINGS)


def _cover(name: bytes) -> list[tuple[int, int, int]]:
    """(offset, first gram, last gram) of the lists that hold every occurrence of a name."""
    if len(name) < 3:
        low = int.from_bytes(name.ljust(3, b"\0"), "big")
        return [(0, low, low | ((1 << 8 * (3 - len(name))) - 1))]
    offsets = sorted({*range(0, len(name) - 2, 3), len(name) - 3})
    return [(o, g, g) for o in offsets for g in [int.from_bytes(name[o : o + 3], "big")]]


def _occurrences(keys: np.ndarray, cover: list[tuple[int, int, int]]) -> np.ndarray:
    """Positions of a name among the sorted (gram, position) of a segment."""
    bounds = [(np.searchsorted(keys, g << PLACE), np.searchsorted(keys, (h + 1) << PLACE), o, g) for o, g, h in cover]
    a, b, offset, _ = min(bounds, key=lambda x: x[1] - x[0])
    found = (keys[a:b] & ((1 << PLACE) - 1)) - offset
    found = found[found >= 0]
    for a, b, o, g in sorted(bounds, key=lambda x: x[1] - x[0])[1:]:
        if not len(found) or a == b:
            return found[:0]
        want = (g << PLACE) | (found + o)
        found = found[keys[np.minimum(a + np.searchsorted(keys[a:b], want), len(keys) - 1)] == want]
    return np.sort(found)


class Names:
    """Trie of names of three bytes and more: an edge is a gram, three bytes on; a rest of one or two bytes is a last gram that overlaps."""

    def __init__(self, names: list[tuple[int, bytes]]):
        down: list[dict[int, int]] = []  # of each depth: node and gram to node
        ends: list[tuple[dict[int, list[int]], ...]] = []  # of each depth: a node's own names; names by node and last gram, a byte or two on
        for number, name in names:
            node = 0
            for depth in range(len(name) // 3):
                if depth == len(down):
                    down.append({})
                    ends.append(({}, {}, {}))
                key = node << 24 | int.from_bytes(name[3 * depth : 3 * depth + 3], "big")
                node = down[depth].setdefault(key, len(down[depth]))
            rest = len(name) % 3
            key = node << 24 | int.from_bytes(name[-3:], "big") if rest else node
            ends[len(name) // 3 - 1][rest].setdefault(key, []).append(number)
        self.down = [self._sorted({k: [v] for k, v in d.items()}) for d in down]
        self.ends = [tuple(self._sorted(d) for d in e) for e in ends]

    @staticmethod
    def _sorted(found: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, their values end to end, and the n + 1 offsets."""
        keys = sorted(found)
        at = np.concatenate([[0], np.cumsum([len(found[k]) for k in keys])]).astype(np.int64)
        return np.array(keys, np.int64), np.array([x for k in keys for x in found[k]], np.int64), at

    @staticmethod
    def _met(table: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in key, value) of all keys that the table has."""
        keys, values, at = table
        if not len(keys) or not len(key):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        own = np.flatnonzero(keys[found] == key)
        first, n = at[found[own]], np.diff(at)[found[own]]
        return np.repeat(own, n), values[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a name, position) of all occurrences, from the sorted (gram, position) of a segment."""
        if not self.down or not len(keys):
            return
        gram, place = keys >> PLACE, keys & ((1 << PLACE) - 1)
        grams = np.full(int(place.max()) + 4, -1, np.int32)  # the gram at each position, -1 if nobody asks for it
        grams[place] = gram
        first = self.down[0][0]
        a, b = np.searchsorted(gram, first), np.searchsorted(gram, first, side="right")
        for i in range(0, len(first), WALKED):  # some first grams at a time
            low, n = a[i : i + WALKED], (b - a)[i : i + WALKED]
            cuts = np.searchsorted(np.cumsum(n), np.arange(PLACES_AT_ONCE, n.sum(), PLACES_AT_ONCE), side="right") if len(n) else []
            for u, v in zip([0, *cuts], [*cuts, len(n)], strict=True):
                m = n[u:v]
                at = place[np.repeat(low[u:v], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                yield from self._walk(grams, at, np.repeat(self.down[0][1][i + u : i + v], m))

    def _walk(self, grams: np.ndarray, at: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def key(at: np.ndarray, node: np.ndarray, on: int) -> np.ndarray:
            g = grams[np.minimum(at + on, len(grams) - 1)].astype(np.int64)
            return np.where(g < 0, -1, node << 24 | g)

        for depth, (own, one, two) in enumerate(self.ends, 1):
            for table, keyed in ((own, node), (one, key(at, node, 3 * depth - 2)), (two, key(at, node, 3 * depth - 1))):
                found, number = self._met(table, keyed)
                if len(found):
                    yield number, at[found]
            if depth == len(self.down):
                return
            found, node = self._met(self.down[depth], key(at, node, 3 * depth))
            at = at[found]
            if not len(at):
                return


class GramIndex(Commits):
    """Grams of a chunk table's segments. ``refresh`` adds the commits it does not have; deleted rows are left out when rows are fetched."""

    options = {"postings": WRITTEN}

    def __init__(self, spark: SparkSession, table: ChunkTable):
        super().__init__(spark, f"{table.root}/grams")
        self.table = table

    def add(self, rows: DataFrame, commit: int) -> None:
        """Indexes a commit's rows (chunk_id, content). Its places are written last and make it whole."""
        self.write(postings(rows), "postings", commit)
        places = self.read("postings", POSTINGS, [commit]).select("segment", F.posexplode(F.arrays_zip("at", "length", "chunk_id")).alias("row", "p"))
        self.write(places.select("segment", "row", "p.*"), "places", commit)

    def refresh(self, upto: int) -> list[int]:
        """Indexes the segments that reads at a commit need; says which were new."""
        base, have = self.table.base(upto), set(self.numbers("places"))
        new = [n for n in self.table.numbers("segments") if base <= n <= upto and n not in have]
        for n in new:
            self.add(self.table.spark.read.parquet(self.table.path("segments", n)), n)
        self.drop("places", [n for n in have if n < base])
        self.drop("postings", [n for n in self.numbers("postings", False) if n < base])
        return new

    def find(self, names: list[str], upto: int = 1 << 30, live: bool = False) -> DataFrame:
        """(name, chunk_id, commit, places): rows that hold a name, case aside, and at which bytes of the content in lower case.

        Deleted rows are still there, unless only ``live`` ones are asked for: then places of others are left out before the look-up.
        """
        base = self.table.base(upto)
        commits = [n for n in self.numbers("places") if base <= n <= upto]
        blocks, held, size = [], [], 0
        for name in dict.fromkeys(names):
            held.append(name)
            size += len(name) + 1
            if size > BLOCK:
                blocks, held, size = [*blocks, held], [], 0
        alive = self.table.live(upto).select("chunk_id", "commit") if live else None
        found = [self._find(block, commits, alive) for block in [*blocks, held] if block]
        out = found[0] if found else self.spark.createDataFrame([], "name string, chunk_id string, commit int, places array<bigint>")
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def _find(self, names: list[str], commits: list[int], alive: DataFrame | None = None) -> DataFrame:
        low = self.spark.createDataFrame([(n,) for n in names], "name string").select("name", F.lower("name").alias("low")).collect()  # as the contents were lowered
        asked = [(r["name"], len(r["low"].encode()), _cover(r["low"].encode()) if r["low"] else []) for r in low]
        ranges = sorted({(g, h) for _, _, cover in asked for _, g, h in cover})
        exact, wide = np.array([g for g, h in ranges if g == h], np.int64), [(g, h) for g, h in ranges if g != h]
        parts = [PART[p] for p in sorted({_part(x << 8) for g, h in ranges for x in range(g >> 8, (h >> 8) + 1)})]

        root, known = self.root, pa.array([name for name, _, _ in asked])
        sizes = np.array([size for _, size, _ in asked])
        trie = Names([(i, r["low"].encode()) for i, r in enumerate(low) if sizes[i] >= 3])
        short = [(i, cover) for i, (_, size, cover) in enumerate(asked) if size < 3]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def answer(batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
                own = {c: batch[c][i] for c in batch.schema.names}
                if not own["chunk_id"].is_valid:
                    raise ValueError(f"{root}: postings of an earlier layout; remove the folder, so that it is made anew")
                at, length, ids = own["at"].values.to_numpy(), own["length"].values.to_numpy(), own["chunk_id"].values
                there = np.zeros(len(at), bool)
                there[own["kept"].values.to_numpy()] = True
                keys = _unpacked([own[p].as_buffer().to_pybytes() for p in parts], exact, wide)
                commit = own["commit"].as_py()

                def rows(number: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
                    row = np.searchsorted(at, places, side="right") - 1
                    inside = there[row] & (places - at[row] + sizes[number] <= length[row])  # not in a row left out, nor in the zeros after a content
                    order = np.lexsort((places[inside], number[inside]))
                    row, places, number = row[inside][order], places[inside][order], number[inside][order]
                    first = np.append(np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0)), len(row))
                    for i in range(0, len(first) - 1, ROWS):
                        cuts = first[i : i + ROWS + 1]
                        a, b, who = cuts[0], cuts[-1], row[cuts[:-1]]
                        found = pa.ListArray.from_arrays((cuts - a).astype(np.int32), pa.array(places[a:b] - at[row[a:b]]))
                        yield pa.RecordBatch.from_arrays([known.take(pa.array(number[cuts[:-1]])), ids.take(pa.array(who)), pa.array(np.full(len(who), commit, np.int32)), found], names=["name", "chunk_id", "commit", "places"])

                for i, cover in short:
                    places = _occurrences(keys, cover) if cover else at
                    yield from rows(np.full(len(places), i), places)
                # a first gram's places come together, and with them all of each name's
                for number, places in trie.find(keys):
                    yield from rows(number, places)

            for batch in batches:
                for i in range(batch.num_rows):
                    yield from answer(batch, i)

        small_batches(self.spark)
        places = self.read("places", PLACES, commits)
        few = places.count() <= SENT
        kept = (places.join(alive, ["commit", "chunk_id"], "left_semi") if alive is not None else places).groupBy("commit", "segment").agg(F.collect_list("row").alias("kept"))
        lists = self.read("postings", POSTINGS, commits).select("commit", "segment", "at", "length", "chunk_id", *parts)
        return lists.join(F.broadcast(kept) if few else kept, ["commit", "segment"]).mapInArrow(run, "name string, chunk_id string, commit int, places array<bigint>")

    def rows(self, name: str, upto: int, where=None) -> DataFrame:
        """Live rows whose content holds a name, case aside, and that satisfy ``where``; reads the segments that have some."""
        found = self.find([name], upto).select("chunk_id", "commit")
        some = found.limit(FETCHED + 1).collect()
        live = self.table.live(upto)
        live = live.where(where) if where is not None else live
        if len(some) <= FETCHED:
            return live.where(F.col("commit").isin(sorted({r["commit"] for r in some})) & F.col("chunk_id").isin([r["chunk_id"] for r in some]))
        return live.join(found, ["chunk_id", "commit"], "left_semi")

"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than space and TAB..CR; in SQL they are
split natively, in Python they are found with numpy over the raw Arrow buffer.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch: texts may be long, so batches stay small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a session of one machine (as in tests) gets one of its own; a cluster must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tesselar-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Workspace:
    """Tables of one run, written to the shared folder.

    ``put`` cuts lineage: a lost executor costs a read, not a recomputation.
    ``drop`` and ``keep`` delete tables no later step reads; what the returned
    DataFrame still reads goes when the driver's JVM ends, as Spark is lazy.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tesselar/{name}-{uuid.uuid4().hex}"
        self.made: set[str] = set()
        fs, root = self._fs(self.root)
        fs.mkdirs(root)
        fs.deleteOnExit(root)

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Workspace:
        """A lasting folder that callers name."""
        ws = cls.__new__(cls)
        ws.spark, ws.root, ws.made = spark, root.rstrip("/"), set()
        return ws

    def names(self) -> list[str]:
        """Tables of the folder."""
        fs, root = self._fs(self.root)
        return [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []

    def whole(self, name: str) -> bool:
        """Whether a table's writer ended."""
        fs, p = self._fs(f"{self.root}/{name}/_SUCCESS")
        return fs.exists(p)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        self.made.add(name)
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._fs(self.path(name))
            fs.delete(p, True)
            self.made.discard(name)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        self.drop(*(self.made - set(names)))


#: Most ids that are sent to every task to pick rows; more are joined.
SENT = 2_000_000


def sent(ids: DataFrame, most: int = SENT) -> DataFrame:
    """A table of one id column, to be sent to every task if it has at most ``most`` rows and joined otherwise."""
    return F.broadcast(ids) if ids.count() <= most else ids


def words(text: Column) -> Column:
    """Words of a text, natively; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def pieces_of(n: int, per: int, least: int = 1) -> int:
    return max(least, -(-n // per))


def prefix_sums(df: DataFrame, part: str, value: str, out: str) -> DataFrame:
    """Adds to each row of (part int, value) the sum of ``value`` over smaller parts.

    Two levels: parts are summed in groups of 4096, so no task orders more than
    4096 rows of the table of parts, or the table of groups, below 16M parts.
    """
    g = df.withColumn("_g", F.floor(F.col(part) / 4096))
    groups = g.groupBy("_g").agg(F.sum(value).alias("_s"))
    before = groups.select("_g", (F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_b"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_g").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("_i", inner).join(before, "_g").withColumn(out, F.col("_i") + F.col("_b")).drop("_g", "_i", "_b")


# --- numpy over Arrow buffers -------------------------------------------------


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices batches so that a block's texts have about ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = _offsets(col)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of about ``rows`` rows from batches ordered by ``by`` (integers), cut between groups only, and where each group begins and ends."""
    held, n, want = [], 0, rows

    def cut(table: pa.Table) -> list[int]:
        keys = np.stack([table[c].to_numpy() for c in by])
        return [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < want:
            continue
        table = pa.Table.from_batches(held)
        at = cut(table)
        if len(at) == 2:  # one group so far
            want = 2 * n
            continue
        yield table.slice(0, at[-2]).combine_chunks(), at[:-1]
        held = table.slice(at[-2]).to_batches()
        n, want = table.num_rows - at[-2], rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the n + 1 offsets; null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    ends = _offsets(col)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of texts into the words."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = space
    left, right = gap[:-2].copy(), gap[2:].copy()
    full = ends[:-1] < ends[1:]
    left[ends[:-1][full]] = True
    right[ends[1:][full] - 1] = True
    starts = np.flatnonzero(~space & left)
    return starts, np.flatnonzero(~space & right) + 1, np.searchsorted(starts, ends)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


WORD_POWERS = Powers(0xD1342543DE82EF95)

#: Bytes of a word that are hashed or compared with numpy; what is longer goes on in Python.
LONG = 64
#: Masks that keep the first n of eight bytes.
FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def lanes_of(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on as a little-endian number; zeros follow the last byte."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word. Different words may share one: where words must be equal, compare them (``distinct_words``)."""
    from xxhash import xxh64_intdigest

    n, lanes = stops - starts, lanes_of(raw)
    out = mix(n.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, min(int(n.max(initial=0)), LONG), 8):
        on = np.flatnonzero(n > at)
        out[on] = mix(out[on] ^ (lanes[starts[on] + at] & FIRST_BYTES[np.minimum(n[on] - at, 8)]))
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] ^= np.uint64(xxh64_intdigest(raw[starts[i] + LONG : stops[i]].tobytes(), 42))
    return mix(out)


def unequal(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, other_starts: np.ndarray, other_stops: np.ndarray) -> np.ndarray:
    """Which words differ, byte by byte, from the words at other places of the same bytes."""
    n, lanes = stops - starts, lanes_of(raw)
    bad = n != other_stops - other_starts
    for at in range(0, min(int(n.max(initial=0)), LONG), 8):
        on = np.flatnonzero(~bad & (n > at))
        bad[on] = ((lanes[starts[on] + at] ^ lanes[other_starts[on] + at]) & FIRST_BYTES[np.minimum(n[on] - at, 8)]) != 0
    for i in np.flatnonzero(~bad & (n > LONG)).tolist():
        bad[i] = not np.array_equal(raw[starts[i] : stops[i]], raw[other_starts[i] : other_stops[i]])
    return bad


def distinct_words(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash and a place of each different word, and for every word the number of its own among them.

    Words are compared, not only their hashes. Hashes ascend and are distinct unless different words share one.
    """
    hashes, first, which = np.unique(word_hashes(raw, starts, stops), return_index=True, return_inverse=True)
    if unequal(raw, starts, stops, starts[first][which], stops[first][which]).any():
        data, seen = raw.tobytes(), {}
        which = np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
        hashes = word_hashes(raw, starts[first], stops[first])
    return hashes, first, which


def give_back() -> None:
    """Hands memory that Python and Arrow have freed back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries
        pass


def gram_hashes(hashes: np.ndarray, k: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Hashes of the n - k + 1 runs of k words, across texts too."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])


# --- connected components -----------------------------------------------------


def components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step
    shuffles at most the edges, aggregates before it gathers and writes its edges
    to the shared folder; the number of steps grows with the logarithm of the
    diameter. Null nodes take no part, loops and repeated edges are harmless.
    """
    now = ws.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{name}0")
    step, before = 0, None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.put(large.where("a <> b").distinct(), f"{name}L{step}")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = ws.put(stars.where("a <> b").distinct(), f"{name}S{step}")
        mark = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        ws.drop(f"{name}L{step}", f"{name}0" if step == 1 else f"{name}S{step - 1}")
        now = after
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""A versioned chunk table on Parquet: segments, tombstones, commits.

A commit writes ``segments/commit=N`` (rows) and ``tombstones/commit=N`` (ids); a
row is alive if no later tombstone names it. What the manifest has not committed
is not read, so a crash leaves orphan files, never wrong rows. Deletes are one
anti-join, whatever their number. A table has one writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

TOMB = T.StructType([T.StructField("chunk_id", T.StringType())])


class Commits:
    """Parquet tables of a folder, one a commit: ``kind/commit=N``, whole once Spark has marked them so."""

    #: Options of the Parquet writer by kind of table.
    options: dict[str, dict[str, str]] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, commit: int) -> str:
        return f"{self.root}/{kind}/commit={commit}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def numbers(self, kind: str, whole: bool = True) -> list[int]:
        """Commits that have a table of the kind, in order; with ``whole`` only those that were written to the end."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = [re.fullmatch(r"commit=(\d+)", x.getPath().getName()) for x in fs.listStatus(p)]
        return sorted(n for n in (int(m[1]) for m in found if m) if not whole or self.there(f"{self.path(kind, n)}/_SUCCESS"))

    def kinds(self) -> list[str]:
        fs, p = self._fs(self.root)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def write(self, rows: DataFrame, kind: str, commit: int) -> None:
        rows.write.mode("overwrite").options(**self.options.get(kind, {})).parquet(self.path(kind, commit))

    def read(self, kind: str, schema: T.StructType, commits: list[int]) -> DataFrame:
        """Rows of some commits with the number of each, in a column ``commit``."""
        both = T.StructType([*schema.fields, T.StructField("commit", T.IntegerType())])
        if not commits:
            return self.spark.createDataFrame([], both)
        return self.spark.read.schema(both).option("basePath", f"{self.root}/{kind}").parquet(*[self.path(kind, n) for n in commits])

    def count(self, kind: str, commit: int) -> int:
        """Rows of a commit's table, by its files' footers; a table without rows is removed."""
        n = self.spark.read.parquet(self.path(kind, commit)).count()
        if not n:
            self.drop(kind, [commit])
        return n

    def drop(self, kind: str, commits: list[int]) -> None:
        for n in commits:
            fs, p = self._fs(self.path(kind, n))
            fs.delete(p, True)

    def drop_after(self, commit: int) -> None:
        """Removes what was written and never committed, so that no later commit takes it for its own."""
        for kind in self.kinds():
            self.drop(kind, [n for n in self.numbers(kind, False) if n > commit])

    def last(self) -> int:
        """The largest number that anything was written under."""
        return max((n for kind in self.kinds() for n in self.numbers(kind, False)), default=0)


class ChunkTable(Commits):
    options = {"segments": {"compression": "zstd"}}

    def __init__(self, spark: SparkSession, root: str, name: str = "specs"):
        super().__init__(spark, f"{root}/{name}")

    def exists(self) -> bool:
        return self.there(f"{self.root}/segments")

    def append(self, records: DataFrame, commit: int) -> None:
        """Adds rows (``schemas.RECORD``) in one segment, clustered by type so that filters skip row groups."""
        self.write(records.select(*schemas.RECORD.fieldNames()).sortWithinPartitions("chunk_type", "fork"), "segments", commit)

    def delete(self, ids: DataFrame, commit: int) -> None:
        self.write(ids.select(F.col("chunk_id").cast("string").alias("chunk_id")).distinct(), "tombstones", commit)

    def replace(self, records: DataFrame, commit: int) -> None:
        """A new snapshot: earlier segments are no longer read. No rows make an empty snapshot."""
        self.append(records, commit)
        self.write(self.spark.createDataFrame([(commit,)], "base int").coalesce(1), "snapshots", commit)

    def base(self, upto: int) -> int:
        return max((n for n in self.numbers("snapshots") if n <= upto), default=0)

    def live(self, upto: int = 1 << 30) -> DataFrame:
        """The rows that are alive after a commit, with the commit that brought each."""
        base = self.base(upto)
        of = lambda kind: [n for n in self.numbers(kind) if base <= n <= upto]
        rows, gone = self.read("segments", schemas.RECORD, of("segments")), of("tombstones")
        if not gone:
            return rows
        last = self.read("tombstones", TOMB, gone).groupBy("chunk_id").agg(F.max("commit").alias("gone"))
        return rows.join(last, (rows["chunk_id"] == last["chunk_id"]) & (last["gone"] > rows["commit"]), "left_anti")

    def compact(self, upto: int, commit: int) -> None:
        """Writes the live rows as a new snapshot."""
        self.replace(self.live(upto).drop("commit"), commit)

    def vacuum(self, oldest: int) -> list[str]:
        """Removes tables that no read at commit ``oldest`` or later needs; says which."""
        base = self.base(oldest)
        old = {kind: [n for n in self.numbers(kind, False) if n < base] for kind in ("segments", "tombstones", "snapshots")}
        for kind, numbers in old.items():
            self.drop(kind, numbers)
        return [f"{kind}/commit={n}" for kind, numbers in old.items() for n in numbers]

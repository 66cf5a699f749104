"""A data source for file trees: ``spark.read.format("tesselar_tree")``.

A row is a file's path below ``base``, its absolute path, time in nanoseconds and
size. Folders are dealt to tasks, which walk them; the driver lists only as many of
the upper ones as make ``folders`` parts. Tests of names, paths and times are made in
the walk, where a file that fails on its path is not even looked at. No file is
opened: ``content`` is a column of its own (``text_of``), which a plan that does not
ask for it leaves out.

Options: path (a folder), base (default: path), names (glob for the file name,
default ``*``), under (a prefix of the path below base), after and before (times in
ns, exclusive), recursive (default true), folders (default 256). They are options and
not filters that Spark pushes: Spark 4.1 keeps pushed filters in the relation, so that
a second query over one DataFrame would miss rows. Files that vanish meanwhile, and
links to nothing, are left out; links to folders are not followed. Paths are those
that driver and executors mount alike.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "tesselar_tree"
SCHEMA = "path string, abs_path string, mtime_ns bigint, size bigint"
KINDS = pa.schema([("path", pa.string()), ("abs_path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64())])
#: Rows that a task hands on at a time.
ROWS = 4096

def local(path: str) -> str:
    """A path or a file: URI as a path."""
    return os.path.abspath(re.sub(r"^file:/+", "/", path))


class Folders(D.InputPartition):
    """Folders of one task: with those below, or only their own files."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path must name a folder")
        self.root = local(options["path"])
        self.base = local(options.get("base") or options["path"]).rstrip("/") + "/"
        self.names = re.compile(fnmatch.translate(options.get("names") or "*"))
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.folders = int(options.get("folders") or 256)
        self.under = options.get("under") or ""
        self.after, self.before = (None if options.get(k) is None else int(options[k]) for k in ("after", "before"))

    def partitions(self) -> list[Folders]:
        """The folders dealt out: upper ones are opened until there are enough of them."""
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        deep, flat = [self.root], []
        while self.recursive and deep and len(deep) < self.folders:
            below = []
            for folder in deep:
                flat.append(folder)
                with os.scandir(folder) as found:
                    below += sorted(x.path for x in found if x.is_dir(follow_symlinks=False))
            deep = below
        if not self.recursive:
            deep, flat = [], [self.root]
        n = max(1, min(self.folders, len(deep) + len(flat)))
        return [Folders(deep[i::n], flat[i::n]) for i in range(n)]

    def _timely(self, time: int) -> bool:
        return (self.after is None or time > self.after) and (self.before is None or time < self.before)

    def _below(self, folder: str) -> bool:
        """Whether files of a folder or below it can have the prefix."""
        path = (folder + "/").removeprefix(self.base)
        return path.startswith(self.under) or self.under.startswith(path)

    def _files(self, part: Folders) -> Iterator[dict]:
        waiting = [(x, True) for x in part.deep] + [(x, False) for x in part.flat]
        while waiting:
            folder, deeper = waiting.pop()
            try:
                with os.scandir(folder) as entries:
                    found = list(entries)
            except (FileNotFoundError, NotADirectoryError):
                continue
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    if deeper and self._below(x.path):
                        waiting.append((x.path, True))
                    continue
                row = {"path": x.path.removeprefix(self.base), "abs_path": x.path}
                if not self.names.match(x.name) or not row["path"].startswith(self.under):
                    continue
                try:
                    stat = x.stat()
                except FileNotFoundError:
                    continue
                row |= {"mtime_ns": stat.st_mtime_ns, "size": stat.st_size}
                if os.path.isfile(x.path) and self._timely(stat.st_mtime_ns):
                    yield row

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for row in self._files(partition):
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, KINDS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, KINDS)


class TreeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def tree(spark: SparkSession, root: str, base: str | None = None, names: str = "*", recursive: bool = True, **options: object) -> DataFrame:
    """(path, abs_path, mtime_ns, size) of the files below a folder; FileNotFoundError if it is not there."""
    if not os.path.isdir(local(root)):
        raise FileNotFoundError(root)
    spark.dataSource.register(TreeSource)
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(FORMAT).options(base=base or root, names=names, recursive=str(recursive).lower(), **given).load(root)


def _read(paths: pa.Array) -> pa.Array:
    out = []
    for path in paths.to_pylist():
        try:
            with open(path, "rb") as f:
                out.append(f.read().decode("utf-8", "replace"))
        except (FileNotFoundError, TypeError):
            out.append(None)
    return pa.array(out, pa.string())


def text_of(abs_path: Column) -> Column:
    """A file's text, read where the row is and only if it is asked for; bytes that are no UTF-8 are replaced, a file that is gone gives null."""
    return F.arrow_udf(_read, T.StringType())(abs_path)


def write_tree(files: DataFrame, root: str) -> int:
    """Writes files (path, content, mtime_ns) below a folder, each in the task that has it; their number. A null time stays the time of writing."""
    top = local(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, time in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = os.path.join(top, path)
                os.makedirs(os.path.dirname(name), exist_ok=True)
                with open(name, "wb") as f:
                    f.write((content or "").encode("utf-8", "surrogatepass"))
                if time is not None:
                    os.utime(name, ns=(time, time))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("path", "content", F.col("mtime_ns").cast("long").alias("mtime_ns")).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_parts(parts: DataFrame, root: str) -> int:
    """Writes parts (path, content, offset in bytes) of files below a folder, each in the task that has it, so that no task holds a file; their number."""
    top = local(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, offset in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = os.path.join(top, path)
                os.makedirs(os.path.dirname(name), exist_ok=True)
                handle = os.open(name, os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    os.pwrite(handle, content.encode("utf-8", "surrogatepass"), offset)
                finally:
                    os.close(handle)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return parts.select("path", "content", F.col("offset").cast("long").alias("offset")).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

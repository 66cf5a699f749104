"""The manifest's file entries as a delta log: checkpoints, and what later commits changed.

``delta/commit=N`` holds the entries that commit N added, changed or (``gone``) took
away, sorted by path; ``checkpoint/commit=N`` all entries after it. A read takes the
newest checkpoint, leaves out the paths that later deltas name and adds the last
entry of each: the checkpoint itself is scanned, not shuffled. A commit writes rows
in proportion to its change; every EVERY deltas a checkpoint is made, after the
commit that it ends with, so a crash in between costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .store import Commits

#: Deltas after which a checkpoint is made.
EVERY = 8

DELTA = T.StructType([*schemas.FILE_ENTRY.fields, T.StructField("gone", T.BooleanType())])


class EntryLog(Commits):
    def __init__(self, spark: SparkSession, root: str, every: int = EVERY):
        super().__init__(spark, root)
        self.every = every

    def _base(self, upto: int) -> int:
        return max((n for n in self.numbers("checkpoint") if n <= upto), default=0)

    def _deltas(self, base: int, upto: int) -> list[int]:
        return [n for n in self.numbers("delta") if base < n <= upto]

    def state(self, upto: int) -> DataFrame:
        """``schemas.FILE_ENTRY`` after a commit."""
        base = self._base(upto)
        deltas, names = self._deltas(base, upto), schemas.FILE_ENTRY.fieldNames()
        rows = self.read("checkpoint", schemas.FILE_ENTRY, [base] if base else []).select(names)
        if not deltas:
            return rows
        late = self.read("delta", DELTA, deltas)
        if len(deltas) > 1:  # one delta has a path once
            late = late.groupBy("path").agg(F.max_by(F.struct(*names[1:], "gone"), "commit").alias("e")).select("path", "e.*")
        return rows.join(late.select("path"), "path", "left_anti").select(names).unionByName(late.where("not gone").select(names))

    def replace(self, entries: DataFrame, commit: int) -> None:
        """All entries of a commit that rebuilt everything."""
        self.write(entries.select(schemas.FILE_ENTRY.fieldNames()).sortWithinPartitions("path"), "checkpoint", commit)

    def append(self, changed: DataFrame, commit: int) -> None:
        """The entries of a commit's changed paths, each path once."""
        self.write(changed.select(DELTA.fieldNames()).sortWithinPartitions("path"), "delta", commit)

    def checkpoint(self, commit: int) -> bool:
        """Makes a checkpoint of a committed state once it has ``every`` deltas."""
        if len(self._deltas(self._base(commit), commit)) < self.every:
            return False
        self.replace(self.state(commit), commit)
        return True

    def vacuum(self, oldest: int) -> list[str]:
        """Removes checkpoints and deltas that no read at commit ``oldest`` or later needs; says which."""
        base = self._base(oldest)
        old = {"checkpoint": [n for n in self.numbers("checkpoint", False) if n < base], "delta": [n for n in self.numbers("delta", False) if n <= base]}
        for kind, numbers in old.items():
            self.drop(kind, numbers)
        return [f"{kind}/commit={n}" for kind, numbers in old.items() for n in numbers]

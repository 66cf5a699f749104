"""Structured Streaming upkeep of an index: events of files become commits.

An event says that a file has a new content, or (``gone``) that it is no more. State
is kept for each (repo, path): the newest time and content hash seen. Files are dealt
to BUCKETS by a hash, and a bucket's files share a state and a call of Python, so that
the number of calls does not grow with that of files. Events that are late, repeated
or change nothing end there; the last one of a file in a micro-batch goes on. A micro-batch is one commit of the index: its deletes and
appends come from the manifest's entries, and its number goes into the header that
makes it valid, so that a batch that runs again after a crash is either done afresh
or left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..functions.lineage import BATCH_BYTES, BATCH_ROWS, small_batches
from ..functions.text import relative_path
from ..plans.incremental import Index

EVENT = T.StructType([*schemas.FILE.fields, T.StructField("gone", T.BooleanType())])
#: Groups that files are dealt to. A bucket's state, some 80 bytes for each of its files, and what a micro-batch has of it are in memory together. Their number belongs to a stream's checkpoint.
BUCKETS = 1 << 13
#: The newest time of a bucket, and its files: each one's newest time and content hash (null: gone).
STATE = "mtime_ns bigint, repos array<string>, paths array<string>, times array<bigint>, hashes array<binary>"
CHANGED = "repo string, path string, abs_path string, file_type string, mtime_ns bigint, content string, gone boolean, sha256 string"
CHANGED_NAMES = [c.split(" ")[0] for c in CHANGED.split(", ")]
#: Spark bounds what the state's Python hands on in rows alone, and keeps the states of buckets that hand on none; so each bucket gives at least one row, and one more for each ROW_BYTES of contents and state. A row without a path says nothing.
ROW_BYTES = BATCH_BYTES // BATCH_ROWS
NOTHING = ("", None, None, None, 0, None, False, None)


def drop_folder(spark: SparkSession, folder: str, file_type: str, repo: str, pattern: str = "*") -> DataFrame:
    """Events of a folder's files as they arrive. A file source sees new files only; changes and deletions must come as events."""
    read = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    found = read.load(folder).select(F.col("value").alias("content"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("abs_path"), (F.unix_micros("_metadata.file_modification_time") * 1000).alias("mtime_ns"))
    return found.select(relative_path(F.col("abs_path"), folder).alias("path"), "abs_path", F.lit(file_type).alias("file_type"), F.lit(repo).alias("repo"), "mtime_ns", "content", F.lit(False).alias("gone"))


def _last(batches: Iterator[pd.DataFrame]) -> dict[tuple[str, str], tuple]:
    """The last event of each file; of equal times the later row, and a deletion, count."""
    last: dict[tuple[str, str], tuple] = {}
    for events in batches:
        for repo, path, abs_path, file_type, time, content, gone in zip(*(events[c].tolist() for c in CHANGED_NAMES[:-1]), strict=True):
            if time is None or pd.isna(time):
                continue
            now = last.get((repo, path))
            if now is None or (time, bool(gone)) >= (now[4], now[6]):
                last[repo, path] = repo, path, abs_path, file_type, int(time), None if gone else content or "", bool(gone)
    return last


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of a bucket's files the last events (``CHANGED``), if they are newer than what was seen and change something."""
    _, *columns = state.get if state.exists else (None, [], [], [], [])
    seen = {(repo, path): (time, sha) for repo, path, time, sha in zip(*columns, strict=True)}
    rows, size, updated = [], 0, False
    for file, event in _last(batches).items():
        time, sha = seen.get(file, (None, None))
        if time is not None and event[4] < time:
            continue
        raw = None if event[6] else event[5].encode("utf-8", "surrogatepass")
        now = None if raw is None else hashlib.sha256(raw).digest()
        if time == event[4] and now == sha:
            continue
        seen[file], updated = (event[4], now), True
        if now is None and time is not None and sha is None:
            continue
        rows.append((*event, now and now.hex()))
        size += len(raw or b"")
    if updated:
        names, values = list(seen), list(seen.values())
        state.update((max(t for t, _ in values), [r for r, _ in names], [p for _, p in names], [t for t, _ in values], [bytes(h) if h is not None else None for _, h in values]))
        size += sum(48 + len(r) + len(p) for r, p in names)
    rows += [NOTHING] * max(1 - len(rows), size // ROW_BYTES)
    for i in range(0, len(rows), BATCH_ROWS):
        yield pd.DataFrame(rows[i : i + BATCH_ROWS], columns=CHANGED_NAMES)


def newest(events: DataFrame) -> DataFrame:
    """The stream of events (``EVENT``) that change something, at most one a file and micro-batch."""
    small_batches(events.sparkSession)
    keyed = events.select(*EVENT.fieldNames()).where("path is not null AND mtime_ns is not null").withColumn("repo", F.coalesce("repo", F.lit("")))
    dealt = keyed.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(_newest, CHANGED, STATE, "append", GroupStateTimeout.NoTimeout).where("path is not null")


def commit(index: Index, batch: DataFrame, mark: dict[str, int]) -> bool:
    """Commits the changes of a micro-batch (``CHANGED``) once; False if it was committed before."""
    found, reason = index.manifest()
    if reason:
        index.index(index.spark.createDataFrame([], schemas.FILE).coalesce(1), force=True)
        found, _ = index.manifest()
    if all(found.marks.get(name, -1) >= number for name, number in mark.items()):
        return False
    files = batch.select(*schemas.FILE.fieldNames(), "gone", "sha256").persist()
    try:
        now = Index.key(files).alias("c")
        m = found.frame(index.spark).alias("m")
        joined = now.join(m, F.col("c.path") == F.col("m.path"), "left").where(~(F.col("c.gone") & F.col("m.path").isNull()))
        kind = F.when(F.col("c.gone"), "delete").when(F.col("m.path").isNull(), "add").when(F.col("c.sha256") == F.col("m.sha256"), "touch").otherwise("modify")
        changes = joined.select("c.path", "c.gone", F.col("m.path").isNull().alias("fresh"), "c.mtime_ns", F.col("m.sha256").alias("old_sha256"), F.coalesce("m.chunk_ids", F.array().cast("array<string>")).alias("old_chunk_ids"), "c.file_type", "c.sha256", kind.alias("change_type")).persist()
        try:
            index.apply(changes, files.where("not gone").select(*schemas.FILE.fieldNames()), found, mark)
        finally:
            changes.unpersist()
    finally:
        files.unpersist()
    return True


def upkeep(events: DataFrame, index: Index, checkpoint: str, name: str = "upkeep") -> StreamingQuery:
    """Keeps an index up to date with a stream of events; streams of one index need names of their own, and run one at a time."""

    def write(batch: DataFrame, number: int) -> None:
        commit(index, batch, {name: number})

    return newest(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

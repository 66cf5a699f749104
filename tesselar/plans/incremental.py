"""Incremental maintenance: diff a manifest with files, re-chunk what changed, commit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import small_batches
from ..functions.vectors import encode
from ..operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_files, to_records
from ..sources.files import hash_of, hashes, listing
from . import manifest as M
from .embeddings import EmbeddingCache
from .entries import EntryLog
from .store import ChunkTable

#: Chunks a new or changed file is taken to have in a dry run.
ESTIMATE = 10
#: Models that are cheaper to run again than to look up.
CHEAP = frozenset({"hashing"})

# What users of the tools read. Kinds of change, in order; the texts of an update and of a dry run.
KINDS = ("add", "modify", "delete")
NOTHING = "No changes detected"
REBUILT = "Full rebuild: {chunks_in} chunks indexed ({reason})"
UPDATED = "Incremental update: {add} added, {modify} modified, {delete} deleted ({chunks_in} chunks added, {chunks_out} deleted)"
WOULD_REBUILD = "Would perform full rebuild: {reason}"
WOULD_UPDATE = "Would perform incremental update:"
WOULD = {"add": "  Add {} files", "modify": "  Modify {} files", "delete": "  Delete {} files", "in": "  ~{} chunks to add", "out": "  ~{} chunks to delete"}


def compute_changes(current: DataFrame, entries: DataFrame, check_hashes: bool = True) -> DataFrame:
    """``schemas.CHANGE`` between files now (path, mtime_ns, sha256) and a manifest's (``schemas.FILE_ENTRY``).

    One full outer join on path. Equal times skip a file whatever its hash; other
    times change it, unless hashes are checked and equal.
    """
    c, m = current.alias("c"), entries.alias("m")
    same = F.col("c.mtime_ns") == F.col("m.mtime_ns")
    if check_hashes:
        same = same | (F.col("c.sha256") == F.col("m.sha256"))
    kind = F.when(F.col("m.path").isNull(), "add").when(F.col("c.path").isNull(), "delete").when(~F.coalesce(same, F.lit(False)), "modify")
    joined = c.join(m, F.col("c.path") == F.col("m.path"), "full_outer")
    none = F.array().cast("array<string>")
    return joined.select(F.coalesce("c.path", "m.path").alias("path"), kind.alias("change_type"), F.when(kind == "add", none).otherwise(F.coalesce("m.chunk_ids", none)).alias("old_chunk_ids")).where("change_type is not null")


def suspects(current: DataFrame, entries: DataFrame) -> DataFrame:
    """Paths whose times differ from the manifest's: only these need a hash."""
    m = entries.select(F.col("path").alias("_p"), F.col("mtime_ns").alias("_m"))
    return current.join(m, (F.col("path") == F.col("_p")) & (F.col("mtime_ns") == F.col("_m")), "left_anti")


def change_counts(changes: DataFrame) -> DataFrame:
    of = lambda k: F.count_if(F.col("change_type") == k)
    return changes.agg(of("add").alias("files_added"), of("modify").alias("files_modified"), of("delete").alias("files_deleted"), F.coalesce(F.sum(F.size("old_chunk_ids")), F.lit(0)).alias("chunks_deleted"))


def estimates(changes: DataFrame) -> DataFrame:
    """What a dry run expects: ESTIMATE chunks for each new or changed file, and the old chunks that go."""
    grows = F.col("change_type").isin("add", "modify")
    return changes.agg(F.coalesce(F.sum(F.when(grows, ESTIMATE).otherwise(0)), F.lit(0)).alias("estimated_chunks_add"), F.coalesce(F.sum(F.when(F.col("change_type") != "add", F.size("old_chunk_ids")).otherwise(0)), F.lit(0)).alias("estimated_chunks_delete"))


def with_types(changes: DataFrame, files: DataFrame, default: str = "spec") -> DataFrame:
    """Adds the file_type of each changed path; a path that is gone counts as ``default``."""
    return changes.join(files.select("path", "file_type"), "path", "left").withColumn("file_type", F.coalesce("file_type", F.lit(default)))


def preview(changes: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` paths, in order, each with how many more there are."""
    more = changes.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return changes.select("path").orderBy("path").limit(most).crossJoin(F.broadcast(more))


def chunks_by_file(records: DataFrame) -> DataFrame:
    """(path, chunk_ids) of chunk records: paths are ``repo/source``, ids sorted."""
    return records.select(F.concat_ws("/", "repo", "source").alias("path"), "chunk_id").groupBy("path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))


def difference(current: DataFrame, entries: DataFrame) -> dict[str, int]:
    """What one aggregate over one join tells: files now, those without a time, paths whose entries are not as they were, entries that break a rule."""
    c = current.select(F.col("path").alias("_now"), F.col("mtime_ns").alias("_time"))
    m = entries.select("path", "mtime_ns", M.broken_rule(F.col("path"), F.col("sha256"), F.col("chunk_ids")).alias("_rule"))
    joined = c.join(m, F.col("_now") == F.col("path"), "full_outer")
    row = joined.agg(F.count("_now").alias("files"), F.count_if(F.col("_now").isNotNull() & F.col("_time").isNull()).alias("untimed"), F.count_if(~F.coalesce(F.col("_time") == F.col("mtime_ns"), F.lit(False))).alias("other"), F.count("_rule").alias("broken")).first()
    return row.asDict()


@dataclass
class Result:
    """What an update did: files by kind of change, chunks that came and went; a reason if everything was rebuilt."""

    files: dict[str, int] = field(default_factory=dict)
    chunks_in: int = 0
    chunks_out: int = 0
    same: int = 0
    reason: str | None = None

    def summary(self) -> str:
        of = {k: self.files.get(k, 0) for k in KINDS}
        text = REBUILT if self.reason is not None else UPDATED if any(of.values()) else NOTHING
        return text.format(chunks_in=self.chunks_in, chunks_out=self.chunks_out, reason=self.reason, **of)


@dataclass
class Plan:
    """What an update would do. ``changes`` (``schemas.CHANGE``) stays a table; only counts are on the driver."""

    reason: str | None = None
    files: dict[str, int] = field(default_factory=dict)
    chunks: tuple[int, int] = (0, 0)
    changes: DataFrame | None = None

    def summary(self) -> str:
        if self.reason is not None:
            return WOULD_REBUILD.format(reason=self.reason)
        lines = [WOULD[k].format(self.files[k]) for k in KINDS if self.files.get(k)]
        return "\n".join([WOULD_UPDATE, *lines, *(WOULD[k].format(n) for k, n in zip(("in", "out"), self.chunks, strict=True))]) if lines else NOTHING

    def first(self, kind: str, most: int = 10) -> list[str]:
        """The first paths of a kind of change."""
        if self.changes is None:
            return []
        return [r["path"] for r in self.changes.where(F.col("change_type") == kind).select("path").orderBy("path").limit(most).collect()]


class Index:
    """A chunk table with its manifest. ``files`` arguments are rows of ``schemas.FILE``, each (repo, path) once.

    One writer at a time. An update writes tombstones, a segment and a delta of
    entries, all for the files that changed, and last the header that makes them
    valid; whatever an update that failed has left is removed before the next.
    """

    def __init__(self, spark: SparkSession, root: str, model: str = "hashing", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, table: str = "specs", cache: bool | None = None):
        self.spark, self.model, self.size, self.overlap = spark, model, size, overlap
        self.table, self.manifest_path = ChunkTable(spark, root, table), f"{root}/{table}.manifest.json"
        self.log = EntryLog(spark, f"{self.table.root}/entries")
        self.cache = EmbeddingCache(spark, f"{root}/vectors", model) if (model not in CHEAP if cache is None else cache) else None
        self.encoded = 0

    @property
    def chunk_config(self) -> dict[str, int]:
        return {"chunk_size": self.size, "chunk_overlap": self.overlap}

    def manifest(self) -> tuple[M.Manifest | None, str | None]:
        """The manifest, and why it cannot be used."""
        try:
            found = M.load(self.manifest_path)
        except M.ManifestError as e:
            return None, f"Manifest unusable: {e}"
        if found is not None and not found.files:
            found.files = M.StoredFiles(self.log.state(found.commit))
        return found, M.needs_rebuild(found, self.model, self.chunk_config)

    @staticmethod
    def key(files: DataFrame) -> DataFrame:
        """Manifest paths are ``repo/path``: equal paths of two repositories differ."""
        return files.withColumn("path", F.concat_ws("/", "repo", "path"))

    def _timed(self, files: DataFrame, untimed: bool) -> DataFrame:
        """(path, mtime_ns) by key; times that rows do not have are taken from the files."""
        return self.key(listing(self.spark, files) if untimed else files).select("path", "mtime_ns")

    def _records(self, chunks: DataFrame) -> DataFrame:
        """Records with vectors; with a cache only contents that it has not are encoded."""
        small_batches(chunks.sparkSession)
        if self.cache is None:
            return to_records(chunks, encode(F.col("content"), self.model))
        self.encoded = self.cache.fill(chunks)
        return to_records(self.cache.attach(chunks, "_vector"), F.col("_vector"))

    def _changes(self, now: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
        """The paths whose times differ: old entry, new time and hash, and the kind of change ('touch' for a new time alone)."""
        c, m = now.alias("c"), entries.alias("m")
        odd = c.join(m, F.col("c.path") == F.col("m.path"), "full_outer").where(~F.coalesce(F.col("c.mtime_ns") == F.col("m.mtime_ns"), F.lit(False)))
        odd = odd.select(F.coalesce("c.path", "m.path").alias("path"), F.col("c.path").isNull().alias("gone"), F.col("m.path").isNull().alias("fresh"), F.coalesce("c.mtime_ns", "m.mtime_ns").alias("mtime_ns"), F.col("m.sha256").alias("old_sha256"), F.coalesce("m.chunk_ids", F.array().cast("array<string>")).alias("old_chunk_ids"))
        read = self.key(files).join(odd.where("not gone").select("path"), "path", "left_semi").select("path", "file_type", hash_of(F.col("content")).alias("sha256"))
        kind = F.when(F.col("gone"), "delete").when(F.col("fresh"), "add").when(F.col("sha256") == F.col("old_sha256"), "touch").otherwise("modify")
        return odd.join(read, "path", "left").withColumn("change_type", kind)

    def index(self, files: DataFrame, force: bool = False) -> Result:
        found, reason = self.manifest()
        if force:
            reason = "Forced"
        if not reason and not self.table.exists():
            reason = "Table missing"
        return self._rebuild(files, found, reason) if reason else self._update(files, found)

    def _commit(self, found: M.Manifest | None, number: int) -> None:
        """Writes the header that makes all tables of a commit valid."""
        M.save(M.Manifest(embedding_model=self.model, chunk_config=self.chunk_config, repo_versions=found.repo_versions if found else {}, marks=found.marks if found else {}, commit=number), self.manifest_path)

    def _rebuild(self, files: DataFrame, found: M.Manifest | None, reason: str) -> Result:
        number = max(found.commit if found else 0, self.table.last(), self.log.last()) + 1
        self.table.replace(self._records(chunk_files(files, self.size, self.overlap)), number)
        times = self._timed(files, files.where("mtime_ns is null").limit(1).count() > 0)
        ids = chunks_by_file(self.table.live(number))
        entries = times.join(hashes(self.key(files)), "path").join(ids, "path", "left")
        self.log.replace(entries.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))), number)
        self._commit(found, number)
        return Result({"add": self.log.state(number).count()}, self.table.live(number).count(), reason=reason)

    def _update(self, files: DataFrame, found: M.Manifest) -> Result:
        entries = found.frame(self.spark)
        now = self._timed(files, False)
        seen = difference(now, entries)
        if seen["untimed"]:
            now = self._timed(files, True)
            seen = difference(now, entries)
        if seen["broken"]:
            return self._rebuild(files, found, f"Manifest unusable: {seen['broken']} entries break a rule")
        if not seen["other"]:
            return Result(same=seen["files"])
        changes = self._changes(now, files, entries).persist()
        try:
            done = self.apply(changes, files, found)
        finally:
            changes.unpersist()
        done.same = seen["files"] - done.files["add"] - done.files["modify"]
        return done

    def apply(self, changes: DataFrame, files: DataFrame, found: M.Manifest, marks: dict[str, int] | None = None) -> Result:
        """Commits changes (as ``_changes`` gives them) of files (``schemas.FILE``); ``marks`` go into the header with them."""
        counted = changes.groupBy("change_type", "file_type").count().collect()
        done = Result({k: sum(r["count"] for r in counted if r["change_type"] == k) for k in KINDS})
        number = found.commit + 1
        self.table.drop_after(found.commit)
        self.log.drop_after(found.commit)
        ids = None
        if any(done.files.values()):
            work = changes.where("change_type in ('add', 'modify')").select(F.col("path").alias("_key"))
            work = F.broadcast(work) if sum(done.files.values()) <= 100_000 else work
            picked = files.join(work, F.concat_ws("/", "repo", "path") == F.col("_key"), "left_semi")
            types = {r["file_type"] for r in counted if r["file_type"]}
            chunks = chunk_files(picked, self.size, self.overlap, types=types).persist()
            old = changes.where("change_type <> 'touch'").select(F.explode("old_chunk_ids").alias("chunk_id"))
            self.table.delete(old.join(chunks, "chunk_id", "left_anti"), number)
            self.table.append(self._records(chunks.join(old, "chunk_id", "left_anti")), number)
            done.chunks_out, done.chunks_in = self.table.count("tombstones", number), self.table.count("segments", number)
            ids = chunks_by_file(chunks)
        delta = changes.select("path", F.coalesce("sha256", "old_sha256").alias("sha256"), "mtime_ns", F.when(F.col("change_type") == "touch", F.col("old_chunk_ids")).alias("_kept"), "gone")
        delta = delta.join(ids, "path", "left") if ids is not None else delta.withColumn("chunk_ids", F.lit(None).cast("array<string>"))
        self.log.append(delta.withColumn("chunk_ids", F.coalesce("_kept", "chunk_ids", F.array().cast("array<string>"))), number)
        if marks:
            found.marks = {**found.marks, **marks}
        self._commit(found, number)
        if ids is not None:
            chunks.unpersist()
        self.log.checkpoint(number)
        return done

    def compact(self) -> None:
        """Live rows as one snapshot and all entries as one checkpoint, as a commit of their own."""
        found, reason = self.manifest()
        if reason:
            raise M.ManifestError(reason)
        number = found.commit + 1
        self.table.drop_after(found.commit)
        self.log.drop_after(found.commit)
        self.table.compact(found.commit, number)
        self.log.replace(self.log.state(found.commit), number)
        self._commit(found, number)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes what only reads of commits before the last ``keep`` need; a reader of an older commit loses its files."""
        found, reason = self.manifest()
        if reason or keep < 1:
            raise M.ManifestError(reason or "the last commit must be kept")
        self.table.drop_after(found.commit)
        self.log.drop_after(found.commit)
        oldest = found.commit - keep + 1
        return self.table.vacuum(oldest) + [f"entries/{x}" for x in self.log.vacuum(oldest)]

    def dry_run(self, files: DataFrame) -> Plan:
        found, reason = self.manifest()
        if reason:
            return Plan(reason)
        entries, now = found.frame(self.spark), self._timed(files, False)
        if difference(now, entries)["untimed"]:
            now = self._timed(files, True)
        changes = self._changes(now, files, entries).where("change_type <> 'touch'").select("path", "change_type", "old_chunk_ids")
        counts, guess = change_counts(changes).first(), estimates(changes).first()
        return Plan(None, dict(zip(KINDS, counts[:3], strict=True)), tuple(guess), changes)

    def live(self) -> DataFrame:
        found, _ = self.manifest()
        return self.table.live(found.commit if found else 0)

    def stats(self) -> DataFrame:
        return self.live().agg(F.count("*").alias("total_chunks")).withColumn("table", F.lit(self.table.root.rsplit("/", 1)[-1]))


def totals(entries: DataFrame) -> DataFrame:
    """Files and chunks of a manifest's entries."""
    return entries.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("chunks"))


def written(index: Index, kinds: Iterable[str] = ("segments", "tombstones")) -> dict[str, int]:
    """Rows that the last commit wrote, by kind of table."""
    found, _ = index.manifest()
    rows = {k: index.table.spark.read.parquet(index.table.path(k, found.commit)).count() if found.commit in index.table.numbers(k) else 0 for k in kinds}
    return rows | {k: index.spark.read.parquet(index.log.path(k, found.commit)).count() if found.commit in index.log.numbers(k) else 0 for k in ("delta", "checkpoint")}

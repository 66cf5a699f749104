"""The manifest: what was indexed, with which settings. Its rename commits a version.

The file is a small header. An index keeps the entries of its files in a log of
Parquet tables beside it (``entries``), so that their number has no limit; entries
in the file itself are read too, within the limits below.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import path_error

VERSION = "1.0.0"
MOST_BYTES, MOST_CHUNKS = 10 << 20, 10_000
_SHA, _VERSION = re.compile(r"[a-f0-9]{64}"), re.compile(r"\d+\.\d+\.\d+")


class ManifestError(Exception):
    pass


class ManifestCorrupted(ManifestError):
    pass


class ManifestInvalid(ManifestError):
    pass


def bad_path(path: str) -> str | None:
    """The first rule a path breaks, as ``functions.text.path_error``."""
    tests = (("traversal", ".." in path), ("absolute", path.startswith("/")), ("drive", path[1:2] == ":"), ("nul", "\0" in path), ("control", bool(re.search(r"[\n\r\t]", path))))
    return next((name for name, broken in tests if broken), None)


@dataclass
class FileEntry:
    sha256: str
    mtime_ns: int
    chunk_ids: list[str] = field(default_factory=list)


class StoredFiles(Mapping[str, FileEntry]):
    """Entries of a table (``schemas.FILE_ENTRY``), read when they are asked for."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @staticmethod
    def _entry(row) -> FileEntry:
        return FileEntry(row["sha256"], row["mtime_ns"], list(row["chunk_ids"]))

    def __getitem__(self, path: str) -> FileEntry:
        row = self.frame.where(F.col("path") == path).first()
        if row is None:
            raise KeyError(path)
        return self._entry(row)

    def __iter__(self) -> Iterator[str]:
        return (r["path"] for r in self.frame.select("path").toLocalIterator())

    def __len__(self) -> int:
        return self.frame.count()

    def values(self) -> Iterator[FileEntry]:
        return (self._entry(r) for r in self.frame.toLocalIterator())

    def totals(self) -> tuple[int, int]:
        """Files and chunks."""
        r = self.frame.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("chunks")).first()
        return r["files"], r["chunks"]


@dataclass
class Manifest:
    version: str = VERSION
    updated_at: str = ""
    embedding_model: str = ""
    chunk_config: dict[str, int] = field(default_factory=dict)
    files: Mapping[str, FileEntry] = field(default_factory=dict)
    repo_versions: dict[str, str] = field(default_factory=dict)
    commit: int = 0
    marks: dict[str, int] = field(default_factory=dict)  # how far each stream that feeds the index has come

    def check(self) -> Manifest:
        if not _VERSION.fullmatch(self.version):
            raise ManifestInvalid(f"version {self.version!r}")
        for path, entry in self.files.items():
            if broken := bad_path(path):
                raise ManifestInvalid(f"path {path!r}: {broken}")
            if not _SHA.fullmatch(entry.sha256):
                raise ManifestInvalid(f"{path}: sha256 {entry.sha256!r}")
            if len(entry.chunk_ids) > MOST_CHUNKS:
                raise ManifestInvalid(f"{path}: {len(entry.chunk_ids)} chunks, most are {MOST_CHUNKS}")
        return self

    @classmethod
    def of(cls, data: dict) -> Manifest:
        if not isinstance(data, dict) or not isinstance(data.get("files", {}), dict):
            raise ManifestInvalid("files must be a mapping")
        try:
            files = {p: FileEntry(**e) for p, e in data.get("files", {}).items()}
            return cls(**{**data, "files": files}).check()
        except TypeError as e:
            raise ManifestInvalid(str(e)) from e

    def frame(self, spark: SparkSession) -> DataFrame:
        """Its files as ``schemas.FILE_ENTRY`` rows."""
        if isinstance(self.files, StoredFiles):
            return self.files.frame
        return spark.createDataFrame([(p, e.sha256, e.mtime_ns, e.chunk_ids) for p, e in self.files.items()], schemas.FILE_ENTRY)


def _file(path: str) -> Path:
    """A path or a file: URI; headers are written by the driver, to a folder it can rename in."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+:/", path):
        raise ManifestError(f"{path}: the manifest needs a mounted folder")
    return Path(re.sub(r"^file:/+", "/", path))


def load(path: str) -> Manifest | None:
    """None if there is none. A file that is no JSON is copied aside before the error is raised."""
    file = _file(path)
    if not file.exists():
        return None
    if file.stat().st_size > MOST_BYTES:
        raise ManifestInvalid(f"{path} is larger than {MOST_BYTES} bytes")
    try:
        data = json.loads(file.read_text(encoding="utf-8"))
    except (json.JSONDecodeError, UnicodeDecodeError) as e:
        shutil.copy2(file, file.with_name(file.name + ".corrupted"))
        raise ManifestCorrupted(str(e)) from e
    except OSError as e:
        raise ManifestCorrupted(str(e)) from e
    return Manifest.of(data)


def save(manifest: Manifest, path: str) -> None:
    """Stamps the time and replaces the file in one step; nothing is left behind on an error. Stored entries stay in their table."""
    manifest.updated_at = datetime.now(UTC).isoformat()
    if isinstance(manifest.files, StoredFiles):
        manifest = replace(manifest, files={})
    file = _file(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=file.parent, prefix=file.name, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(asdict(manifest), out, ensure_ascii=False)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, file)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def needs_rebuild(manifest: Manifest | None, model: str, chunk_config: dict[str, int]) -> str | None:
    """Why everything must be indexed anew, or None. Settings that the manifest leaves empty are not compared."""
    if manifest is None:
        return "No manifest exists"
    if manifest.embedding_model and manifest.embedding_model != model:
        return f"Embedding model changed: {manifest.embedding_model} -> {model}"
    if manifest.chunk_config and manifest.chunk_config != chunk_config:
        return f"Chunk config changed: {manifest.chunk_config} -> {chunk_config}"
    return None


def broken_rule(path: Column, sha256: Column, chunk_ids: Column) -> Column:
    """The first rule that a file entry breaks, or null."""
    return F.coalesce(path_error(path), F.when(~F.coalesce(sha256.rlike(r"\A[a-f0-9]{64}\z"), F.lit(False)), "sha256"), F.when(F.size(chunk_ids) > MOST_CHUNKS, "chunks"))


def violations(entries: DataFrame) -> DataFrame:
    """(path, rule) of file entries that break a rule; no row if all are sound."""
    return entries.select("path", broken_rule(F.col("path"), F.col("sha256"), F.col("chunk_ids")).alias("rule")).where("rule is not null")

"""File trees as DataFrames: one row a file, tagged with type and repository.

Trees are walked by the data source of ``tree``; a plan that does not use a file's
content does not open it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.clients import SUFFIXES
from .tree import local as tree_path  # noqa: F401  for callers of this module
from .tree import text_of, tree, write_parts, write_tree  # noqa: F401


def _files(spark: SparkSession, root: str, names: str, base: str, file_type: str, repo: str, recursive: bool = True, where: Column | None = None) -> DataFrame:
    """``schemas.FILE`` of a tree; contents are read when they are asked for."""
    rows = tree(spark, root, base, names, recursive)
    rows = rows if where is None else rows.where(where)
    return rows.select("path", "abs_path", F.lit(file_type).alias("file_type"), F.lit(repo).alias("repo"), "mtime_ns", text_of(F.col("abs_path")).alias("content"))


def _name() -> Column:
    return F.element_at(F.split("abs_path", "/"), -1)


def _outside(*folders: str) -> Column:
    out = ~F.contains("abs_path", F.lit(folders[0]))
    for folder in folders[1:]:
        out = out & ~F.contains("abs_path", F.lit(folder))
    return out


def _python() -> Column:
    return _outside("__pycache__") & ~F.startswith(_name(), F.lit("test_"))


def spec_files(spark: SparkSession, checkout: str, repo: str = "consensus-specs") -> DataFrame:
    """``specs/**/*.md``"""
    return _files(spark, f"{checkout}/specs", "*.md", checkout, "spec", repo)


def eip_files(spark: SparkSession, checkout: str, repo: str = "EIPs") -> DataFrame:
    """``EIPS/eip-*.md``, not below"""
    return _files(spark, f"{checkout}/EIPS", "eip-*.md", checkout, "eip", repo, False)


def builder_files(spark: SparkSession, checkout: str, repo: str = "builder-specs") -> DataFrame:
    return _files(spark, f"{checkout}/specs", "*.md", checkout, "builder", repo)


def python_spec_files(spark: SparkSession, checkout: str, repo: str = "leanSpec") -> DataFrame:
    """``src/lean_spec/**/*.py`` without caches and tests"""
    return _files(spark, f"{checkout}/src/lean_spec", "*.py", checkout, "lean", repo, where=_python())


def python_files(spark: SparkSession, checkout: str, repo: str) -> DataFrame:
    """``**/*.py`` without caches and tests, tagged with their own repository"""
    return _files(spark, checkout, "*.py", checkout, "lean", repo, where=_python())


def rust_files(spark: SparkSession, checkout: str, repo: str) -> DataFrame:
    """``**/*.rs`` outside ``target``; tests stay"""
    return _files(spark, checkout, "*.rs", checkout, f"rust:{repo}", repo, where=_outside("/target/", "__pycache__"))


def rust_source_files(spark: SparkSession, checkout: str, repo: str) -> DataFrame:
    """As ``rust_files``, without files that have ``test`` in their name"""
    return rust_files(spark, checkout, repo).where(~F.contains(F.lower(_name()), F.lit("test")))


def notes_files(spark: SparkSession, checkout: str, repo: str = "pm") -> DataFrame:
    return _files(spark, checkout, "*.md", checkout, "pm", repo)


def client_files(spark: SparkSession, checkout: str, client: str, language: str) -> DataFrame:
    """(path, content, client, language); LookupError for a language without a parser"""
    if language not in SUFFIXES:
        raise LookupError(f"Unsupported language: {language}")
    rows = _files(spark, checkout, SUFFIXES[language], checkout, "client", client)
    return rows.select("path", "content", F.lit(client).alias("client"), F.lit(language).alias("language"))


def union_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, abs_path, file_type, repo, mtime_ns) with nanosecond times, taken where the rows are; files that are gone are left out."""

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = []
            for path in batch.column(1).to_pylist():
                try:
                    times.append(os.stat(path).st_mtime_ns)
                except FileNotFoundError:
                    times.append(None)
            found = batch.append_column("mtime_ns", pa.array(times, pa.int64()))
            yield found.filter(found.column("mtime_ns").is_valid())

    return files.select("path", "abs_path", "file_type", "repo").mapInArrow(stat, "path string, abs_path string, file_type string, repo string, mtime_ns bigint")


def hash_of(content: Column) -> Column:
    """SHA-256 of a text's bytes."""
    return F.sha2(content.cast("binary"), 256)


def hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of texts' bytes"""
    return files.select("path", hash_of(F.col("content")).alias("sha256"))


def binary_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files below a folder, by bytes"""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


def read_json_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array of rows; a file that is not there is empty."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_client_items(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_rows(spark, f"{folder}/items.json", schemas.ITEM)


def load_client_constants(spark: SparkSession, folder: str) -> DataFrame:
    return read_json_rows(spark, f"{folder}/constants.json", schemas.CONSTANT)


def read_compiled(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schemas.COMPILED).option("multiLine", True).json(folder)


def write_compiled(compiled: DataFrame, folder: str) -> None:
    compiled.write.mode("overwrite").json(folder)


def on_disk(spark: SparkSession, registry: DataFrame, root: str) -> DataFrame:
    """A registry with whether each repository is checked out below ``root``."""
    there = [(x,) for x in (sorted(os.listdir(root)) if os.path.isdir(root) else []) if os.path.isdir(os.path.join(root, x))]
    present = spark.createDataFrame(there, "repo string").withColumn("present", F.lit(True))
    return registry.join(present, "repo", "left").withColumn("present", F.coalesce("present", F.lit(False)))

"""Compilation of client sources: extraction by language, statistics, name index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import extract

# File suffix by supported language.
SUFFIXES = {"rust": "*.rs", "go": "*.go", "java": "*.java"}


def compile_clients(files: DataFrame, aware: bool = False) -> DataFrame:
    """``schemas.EXTRACTED`` of client files (path, content, client, language in SUFFIXES)."""
    known = files.where(F.col("language").isin(*SUFFIXES))
    return extract(known, F.col("language"), F.col("client"), F.col("language"), aware)


def unsupported(registry: DataFrame) -> DataFrame:
    """(client, error) for clients whose language has no parser."""
    return registry.where(~F.col("language").isin(*SUFFIXES)).select(F.col("repo").alias("client"), F.concat(F.lit("Unsupported language: "), F.col("language")).alias("error"))


def name_index(extracted: DataFrame) -> DataFrame:
    """(client, category, name, file, line, value): functions, structs, interfaces and constants by name; the last in file order stays."""
    category = F.when(F.col("row_type") == "constant", "constants").when(F.col("kind").isin("function", "struct", "interface"), F.concat(F.col("kind"), F.lit("s")))
    found = extracted.withColumn("category", category).where("category is not null")
    last = F.max_by(F.struct(F.col("file_path").alias("file"), F.col("line_number").alias("line"), "value"), F.struct("file_path", "ordinal"))
    return found.groupBy("client", "category", "name").agg(last.alias("at")).select("client", "category", "name", "at.*")


def statistics(extracted: DataFrame) -> DataFrame:
    """Counts by client, and over all (client null): files, items, constants, functions, structs, interfaces."""
    of = lambda kind: F.count_if((F.col("row_type") == "item") & (F.col("kind") == kind))
    return extracted.rollup("client").agg(
        F.count_distinct("file_path").alias("files"), F.count_if(F.col("row_type") == "item").alias("items"), F.count_if(F.col("row_type") == "constant").alias("constants"),
        of("function").alias("functions"), of("struct").alias("structs"), of("interface").alias("interfaces"),
    )


def counted(rows: DataFrame, by: str, passed: Column) -> DataFrame:
    """(by, n, passed): rows of each group, and those that pass a test, as for the steps and repositories of a status report."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))


def lookup(extracted: DataFrame, name: str, row_type: str = "item", kind: str | None = None) -> DataFrame:
    """The first row, in file order, of an item or constant by name."""
    rows = extracted.where((F.col("row_type") == row_type) & (F.col("name") == name))
    return (rows.where(F.col("kind") == kind) if kind else rows).orderBy("file_path", "ordinal").limit(1)

"""Static compilation of spec files: constants, functions and types by fork, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, strip

# What a constants table row, a function, a type and a fenced block that starts with the function NAME look like.
CONSTANT_ROW = r"\|\s*`?([A-Z][A-Z0-9_]+)`?\s*\|\s*`?([^|`]+)`?\s*\|"
FUNCTION_NAME = r"(?m)^def\s+([a-z_][a-z0-9_]*)\s*\("
TYPE_NAME = r"(?m)^class\s+([A-Z][a-zA-Z0-9_]*)"
FUNCTION_BLOCK = r"(?s)```python\n(def\s+NAME\s*\([^)]*\)[^`]*?)```"


def constant_cells(content: Column) -> Column:
    """array of (name, value) of the rows of constants tables, values trimmed."""
    group = lambda i: F.regexp_extract_all(content, F.lit(CONSTANT_ROW), F.lit(i))
    return F.transform(F.arrays_zip(group(1).alias("name"), group(2).alias("value")), lambda x: F.struct(x["name"].alias("name"), strip(x["value"]).alias("value")))


def constants(files: DataFrame) -> DataFrame:
    """(fork, name, value) from files (fork, path, content): the last in path order, then in text order."""
    cells = files.select("fork", "path", F.posexplode(constant_cells(F.col("content"))).alias("at", "cell"))
    return cells.groupBy("fork", F.col("cell.name").alias("name")).agg(F.max_by("cell.value", F.struct("path", "at")).alias("value"))


def names(files: DataFrame, pattern: str) -> DataFrame:
    """(fork, names): the distinct names, sorted."""
    found = files.select("fork", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("name"))
    return found.groupBy("fork").agg(F.array_sort(F.collect_set("name")).alias("names"))


def compile_specs(files: DataFrame) -> DataFrame:
    """``schemas.COMPILED`` of spec files (fork, path, content); forks where nothing is found are left out."""
    pairs = constants(files).groupBy("fork").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("constants"))
    functions, types = names(files, FUNCTION_NAME), names(files, TYPE_NAME)
    joined = pairs.join(functions.withColumnRenamed("names", "functions"), "fork", "full").join(types.withColumnRenamed("names", "types"), "fork", "full")
    none = F.array().cast("array<string>")
    return joined.select("fork", F.coalesce("constants", F.create_map().cast("map<string,string>")).alias("constants"), F.coalesce("functions", none).alias("functions"), F.coalesce("types", none).alias("types"))


def grep_constant(compiled: DataFrame, name: str, fork: str) -> DataFrame:
    """(fork, name, value, origin) of an exact name in a fork's compiled constants; no row if it is not there."""
    value = F.try_element_at("constants", F.lit(name))
    return compiled.where((F.col("fork") == fork) & value.isNotNull()).select("fork", F.lit(name).alias("name"), value.alias("value"), F.lit("compiled").alias("origin"))


def function_source(files: DataFrame, name: str, fork: str) -> DataFrame:
    """(path, source) of the first fenced block, in path order, that starts with the function."""
    block = F.regexp_extract("content", FUNCTION_BLOCK.replace("NAME", quoted(name)), 1)
    return files.where(F.col("fork") == fork).select("path", block.alias("source")).where("source <> ''").orderBy("path").limit(1)

"""Explicit schemas: nothing in the engine is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name kind, ..." without a session."""
    pairs = [c.split(" ", 1) for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


FILE = _struct("path string, abs_path string, file_type string, repo string, mtime_ns bigint, content string")
CHUNK = _struct("content string, source string, fork string, section string, chunk_type string, metadata map<string,string>, repo string, ordinal int, chunk_id string")
RECORD = _struct(
    "chunk_id string, content string, source string, repo string, fork string, section string, chunk_type string, vector array<float>, "
    "eip string, title string, function_name string, h1 string, h2 string, h3 string, client string, language string, signature string, visibility string, constant_name string"
)
FILE_ENTRY = _struct("path string, sha256 string, mtime_ns bigint, chunk_ids array<string>")
CHANGE = _struct("path string, change_type string, old_chunk_ids array<string>")
ITEM = _struct("kind string, name string, signature string, body string, doc_comment string, file_path string, line_number int, visibility string, attributes array<string>, language string, client string")
CONSTANT = _struct("name string, value string, type_annotation string, doc_comment string, file_path string, line_number int, language string, client string")
EXTRACTED = _struct("row_type string, ordinal int, kind string, name string, signature string, body string, value string, type_annotation string, doc_comment string, file_path string, line_number int, visibility string, attributes array<string>, language string, client string")
COMPILED = _struct("fork string, constants map<string,string>, functions array<string>, types array<string>")
HIT = _struct("content string, source string, fork string, section string, chunk_type string, score double, eip string, function_name string, client string, language string, chunk_id string, repo string, github_url string")

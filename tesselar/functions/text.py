"""Scalar operators as column expressions (built-in functions only).

Patterns are Java regular expressions; lengths and cuts count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forks that a path may name, in order.
PATH_FORKS = ("phase0", "altair", "bellatrix", "capella", "deneb", "electra", "fulu", "gloas")

# The patterns that decide types.
FUNCTION = r"(?m)^def\s+\w+\s*\("
CONSTANT_CELL = r"\|\s*`?[A-Z][A-Z0-9_]+`?\s*\|"
CLASS = r"(?m)^class\s+\w+"
HTTP_CALL = r"(POST|GET|PUT|DELETE)\s+`?/"
CONTAINER = r"class\s+\w+\s*\(Container\)"
FENCED_CLASS = r"```python\s*class"
FRONTMATTER = r"(?s)\A---\n(.*?)\n---"
EIP_FILE = r"eip-(\d+)"


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def chunk_id(project: Column, source_type: Column, source_file: Column, index: Column, content: Column) -> Column:
    """``{project}_{type}_{sha256(file)[:8]}_{index, 4 digits}_{sha256(content)[:8]}``; null if any part is."""
    return F.concat(project, F.lit("_"), source_type, F.lit("_"), short_hash(source_file), F.lit("_"), F.format_string("%04d", index), F.lit("_"), short_hash(content))


def checked_chunk_id(project: Column, source_type: Column, source_file: Column, index: Column, content: Column) -> Column:
    """``chunk_id`` with its parts checked; raises on a bad path or id."""
    made = chunk_id(project, source_type, source_file, index, content)
    bad = path_error(source_file)
    return F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("bad path: "), bad)).cast("string")).when(~is_chunk_id(made), F.raise_error(F.lit("bad chunk id")).cast("string")).otherwise(made)


def fork_of_path(path: Column) -> Column:
    """The first component that is a known fork, whatever its case; else null."""
    return F.get(F.filter(F.split(F.lower(path), "/"), lambda x: x.isin(*PATH_FORKS)), F.lit(0))


def relative_path(path: Column, base: str | None) -> Column:
    """The path below ``base``; one that is not below it stays as it is."""
    if not base:
        return path
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def path_error(path: Column) -> Column:
    """The first rule a path breaks (traversal, absolute, drive, nul, control), or null."""
    return (
        F.when(F.contains(path, F.lit("..")), "traversal")
        .when(F.startswith(path, F.lit("/")), "absolute")
        .when(path.rlike(r"(?s)\A.:"), "drive")
        .when(F.contains(path, F.lit("\0")), "nul")
        .when(path.rlike(r"[\n\r\t]"), "control")
    )


def is_chunk_id(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z0-9_-]+\z") & (F.length(value) <= 200)


def spec_chunk_type(content: Column) -> Column:
    return F.when(content.rlike(FUNCTION), "function").when(content.rlike(CONSTANT_CELL), "constant").when(content.rlike(CLASS), "type").otherwise("spec")


def builder_chunk_type(content: Column) -> Column:
    return F.when(content.rlike(HTTP_CALL), "builder_api").when(content.rlike(CONTAINER) | content.rlike(FENCED_CLASS), "builder_type").otherwise("builder_spec")


def strip(text: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def frontmatter(content: Column) -> Column:
    """map of the leading ``---`` block's ``key: value`` lines, split at the first colon and trimmed; the last of equal keys stays."""
    lines = F.filter(F.split(F.regexp_extract(content, FRONTMATTER, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def eip_number(file_name: Column) -> Column:
    found = F.regexp_extract(file_name, EIP_FILE, 1)
    return F.when(found == "", "unknown").otherwise(found)


def section(h1: Column, h2: Column) -> Column:
    """h2, else h1, else 'unknown'; empty counts as missing."""
    return F.coalesce(F.nullif(h2, F.lit("")), F.nullif(h1, F.lit("")), F.lit("unknown"))


def cut(text: Column, above: int, keep: int, mark: str) -> Column:
    """Texts longer than ``above`` become their first ``keep`` code points and a mark."""
    return F.when(F.length(text) > above, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


# Marks of bodies that were cut.
CLIENT_MARK, RUST_MARK, PYTHON_MARK = "\n// ... truncated ...", "\n// ... (truncated)", "\n    # ... (truncated)"


def cut_client_body(body: Column, most: int = 2000) -> Column:
    return cut(body, most, most, CLIENT_MARK)


def cut_rust_body(body: Column) -> Column:
    return cut(body, 3000, 2500, RUST_MARK)


def cut_class(body: Column) -> Column:
    return cut(body, 3000, 2500, PYTHON_MARK)


def cut_function(body: Column) -> Column:
    return cut(body, 2000, 1800, PYTHON_MARK)


def is_constant_name(name: Column) -> Column:
    """Has a cased letter and none in lower case."""
    return (F.upper(name) == name) & (F.lower(name) != name)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def client_item_content(doc: Column, signature: Column, body: Column, most: int = 2000) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("// "), _some(doc)), signature, cut_client_body(body, most))


def client_item_type(kind: Column) -> Column:
    return F.concat(F.lit("client_"), kind)


def _declared(name: Column, kind: Column, value: Column, end: str) -> Column:
    return F.concat(F.lit("const "), name, F.coalesce(F.concat(F.lit(": "), _some(kind)), F.lit("")), F.lit(" = "), value, F.lit(end))


def client_constant_content(doc: Column, name: Column, kind: Column, value: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("// "), _some(doc)), _declared(name, kind, value, ""))


def rust_item_content(doc: Column, attributes: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("/// "), _some(doc)), F.coalesce(attributes, F.array().cast("array<string>")), cut_rust_body(body))


def rust_constant_content(doc: Column, name: Column, kind: Column, value: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("/// "), _some(doc)), _declared(name, kind, value, ";"))


def score(distance: Column) -> Column:
    return F.lit(1.0) - distance


def shown_share(node: Column, stake: Column) -> Column:
    """The node share unless it is null or zero, else the stake share."""
    return F.coalesce(F.nullif(node, F.lit(0.0)), stake)


def preview(content: Column, most: int = 500) -> Column:
    return F.substring(content, 1, most)


def shown_score(value: Column) -> Column:
    return F.format_string("%.3f", value)


def quoted(name: str) -> str:
    """A name as a literal in a Java pattern."""
    return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"

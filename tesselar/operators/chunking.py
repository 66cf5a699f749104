"""Files to chunks: routed by type, numbered inside each file, no shuffle.

``chunk_files`` takes rows of ``schemas.FILE`` and gives rows of ``schemas.CHUNK``.
A file's chunks leave one task together, so their running number needs no window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import text as X
from ..functions.lineage import small_batches
from .codeparse import parse
from .pycode import python_rows
from .splitting import by_headers, by_size

CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
#: Sections longer than this are split by size, whatever the chunk size.
SPLIT_ABOVE = 1500
_PARTS = "content string, source string, fork string, section string, chunk_type string, metadata map<string,string>, repo string, ordinal int"

# Project names in chunk ids by file type.
PROJECTS = {"spec": "specs", "eip": "eips", "builder": "builder", "pm": "pm", "lean": "lean"}


def _sections(text: str, size: int, overlap: int) -> Iterator[tuple[str | None, str | None, str | None, str, str, int | None]]:
    """h1, h2, h3, the whole section, the piece, its number if the section was split."""
    for s in by_headers(text):
        if len(s.content) > SPLIT_ABOVE:
            yield from ((*s[:3], s.content, piece, i) for i, piece in enumerate(by_size(s.content, size, overlap)))
        else:
            yield *s[:3], s.content, s.content, None


def markdown_pieces(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[dict]:
    out = []
    for h1, h2, h3, whole, piece, sub in _sections(text or "", size, overlap):
        meta = {"h1": h1, "h2": h2, "h3": h3} | ({} if sub is None else {"sub_chunk": str(sub)})
        out.append({"whole": whole, "content": piece, "metadata": meta})
    return out


#: Fixed value: a fenced Python block that starts with a function.
FUNCTION_BLOCK = r"(?s)```python\n(def\s+(\w+)\s*\([^`]+?)```"


def fenced_functions(text: str | None) -> list[dict]:
    """The fenced Python blocks of a file that start with ``def``, as pieces without a section."""
    return [{"whole": None, "content": m[1].strip(), "metadata": {"function_name": m[2]}} for m in re.finditer(FUNCTION_BLOCK, text or "", re.ASCII)]


#: Code points of sections and pieces that a task hands on at a time.
OUT = 2 << 20


def _markdown(files: DataFrame, size: int, overlap: int, kind: Column, functions: bool = False) -> DataFrame:
    """Rows with content, metadata, kind, at (number in the file) for each piece of a markdown file; with ``functions`` its fenced functions follow.

    ``kind`` is said of ``whole``, the piece's whole section (null for a function). A section leaves Python once with all
    its pieces, not once for each of them.
    """
    kept = [f for f in files.schema.fields if f.name != "content"]
    small_batches(files.sparkSession)
    piece = pa.struct([("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("at", pa.int32())])

    def sections(text: str) -> Iterator[tuple[str | None, list[dict]]]:
        at = 0
        for s in by_headers(text):
            parts = enumerate(by_size(s.content, size, overlap)) if len(s.content) > SPLIT_ABOVE else [(None, s.content)]
            own = [("h1", s.h1), ("h2", s.h2), ("h3", s.h3)]
            pieces = [{"content": part, "metadata": own if sub is None else [*own, ("sub_chunk", str(sub))]} for sub, part in parts]
            yield s.content, [{**p, "at": at + i} for i, p in enumerate(pieces)]
            at += len(pieces)
        for i, p in enumerate(fenced_functions(text) if functions else []):
            yield None, [{"content": p["content"], "metadata": list(p["metadata"].items()), "at": at + i}]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, others = batch.column(batch.schema.get_field_index("content")), [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            rows, n = [], 0

            def made(rows: list, others: list = others) -> pa.RecordBatch:
                who = pa.array([r[0] for r in rows], pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(who) for c in others), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(piece))], names=[*(f.name for f in kept), "whole", "pieces"])

            for i, text in enumerate(texts):
                for whole, pieces in sections(text.as_py() or ""):
                    rows.append((i, whole, pieces))
                    n += len(whole or "") + 256 * len(pieces)
                    if n >= OUT:
                        yield made(rows)
                        rows, n = [], 0
            if rows:
                yield made(rows)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    found = files.select(*[f.name for f in kept], "content").mapInArrow(cut, f"{kinds}, whole string, pieces array<struct<content: string, metadata: map<string,string>, at: int>>")
    return found.select(*[f.name for f in kept], kind.alias("kind"), F.explode("pieces").alias("_p")).select(*[f.name for f in kept], "kind", "_p.*")


def _h(level: str) -> Column:
    return F.element_at("metadata", level)


def spec_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Sections typed by the whole section's text, then a chunk for every fenced function of the file."""
    cut = _markdown(files.select("path", "repo", "content"), size, overlap, F.when(F.col("whole").isNotNull(), X.spec_chunk_type(F.col("whole"))), True)
    name = _h("function_name")
    function = F.col("kind").isNull()
    section = F.when(function, name).otherwise(X.section(_h("h1"), _h("h2")))
    kind = F.when(function, "function").otherwise(F.col("kind"))
    return cut.select("content", F.col("path").alias("source"), X.fork_of_path(F.col("path")).alias("fork"), section.alias("section"), kind.alias("chunk_type"), "metadata", "repo", F.col("at").alias("ordinal"))


def function_blocks(content: Column) -> Column:
    """array of (body, name) of the fenced Python blocks that start with ``def``."""
    group = lambda i: F.regexp_extract_all(content, F.lit(FUNCTION_BLOCK), F.lit(i))
    return F.arrays_zip(group(1).alias("body"), group(2).alias("name"))


def function_chunks(files: DataFrame) -> DataFrame:
    found = files.select("path", "repo", F.posexplode(function_blocks(F.col("content"))).alias("at", "block"))
    name = F.col("block.name")
    return found.select(F.trim(F.regexp_replace(F.col("block.body"), r"\A\s+|\s+\z", "")).alias("content"), F.col("path").alias("source"), X.fork_of_path(F.col("path")).alias("fork"), name.alias("section"), F.lit("function").alias("chunk_type"), F.create_map(F.lit("function_name"), name).alias("metadata"), "repo", F.col("at").cast("int").alias("ordinal"))


def eip_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    meta = X.frontmatter(F.col("content"))
    base = files.select("path", "repo", "content", X.eip_number(F.element_at(F.split("path", "/"), -1)).alias("eip"), *[F.element_at(meta, k).alias(k) for k in ("title", "status", "category")])
    cut = _markdown(base, size, overlap, F.lit("eip"))
    own = F.create_map(*[x for k in ("eip", "title", "status", "category") for x in (F.lit(k), F.col(k))])
    present = F.map_filter("metadata", lambda k, v: v.isNotNull())
    return cut.select("content", F.col("path").alias("source"), F.lit(None).cast("string").alias("fork"), X.section(_h("h1"), _h("h2")).alias("section"), F.lit("eip").alias("chunk_type"), F.map_concat(own, present).alias("metadata"), "repo", F.col("at").alias("ordinal"))


def builder_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    cut = _markdown(files.select("path", "repo", "content"), size, overlap, X.builder_chunk_type(F.col("whole")))
    meta = F.map_concat(F.create_map(F.lit("spec_type"), F.lit("builder")), F.col("metadata"))
    return cut.select("content", F.col("path").alias("source"), F.lit(None).cast("string").alias("fork"), X.section(_h("h1"), _h("h2")).alias("section"), F.col("kind").alias("chunk_type"), meta.alias("metadata"), "repo", F.col("at").alias("ordinal"))


def notes_chunks(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Meeting notes: plain markdown of type ``pm``."""
    cut = _markdown(files.select("path", "repo", "content"), size, overlap, F.lit("pm"))
    return cut.select("content", F.col("path").alias("source"), F.lit(None).cast("string").alias("fork"), X.section(_h("h1"), _h("h2")).alias("section"), F.lit("pm").alias("chunk_type"), "metadata", "repo", F.col("at").alias("ordinal"))


def python_chunks(files: DataFrame) -> DataFrame:
    small_batches(files.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (content, f.path, None, section, kind, meta, f.repo, i)
                for f in pdf.itertuples(index=False)
                for i, (section, kind, content, meta) in enumerate(python_rows(f.content or "", f.path or ""))
            ]
            yield pd.DataFrame(rows, columns=["content", "source", "fork", "section", "chunk_type", "metadata", "repo", "ordinal"])

    return files.select("path", "repo", "content").mapInPandas(cut, _PARTS)


def extract(files: DataFrame, rules: Column | str, client: Column | str | None = None, language: Column | str | None = None, aware: bool = False) -> DataFrame:
    """Items and constants (``schemas.EXTRACTED``) of source files (path, content); ``rules`` names the parser of each row."""
    as_col = lambda x: F.lit("") if x is None else F.lit(x) if isinstance(x, str) else x
    rows = files.select("path", "content", as_col(rules).alias("rules"), as_col(client).alias("client"), as_col(language).alias("language"))
    names = schemas.EXTRACTED.fieldNames()
    small_batches(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for f in pdf.itertuples(index=False):
                for i, x in enumerate(parse(f.content or "", f.rules, aware)):
                    out.append((x.row_type, i, x.kind, x.name, x.signature, x.body, x.value, x.type_annotation, x.doc_comment, f.path, x.line_number, x.visibility, x.attributes, f.language, f.client))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schemas.EXTRACTED)


def rust_chunks(files: DataFrame, tree: bool = True) -> DataFrame:
    """Chunks of Rust files (path, repo, content): items in order, then constants."""
    found = extract(files, "rust_tree" if tree else "rust_spec", client=F.col("repo"), aware=tree)
    item = F.col("row_type") == "item"
    content = F.when(item, X.rust_item_content(F.col("doc_comment"), F.col("attributes"), F.col("body"))).otherwise(X.rust_constant_content(F.col("doc_comment"), F.col("name"), F.col("type_annotation"), F.col("value")))
    as_map = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    line = F.col("line_number").cast("string")
    items = as_map(function_name=F.when(F.col("kind") == "function", F.col("name")).otherwise(""), signature=F.col("signature"), visibility=F.col("visibility"), line_number=line, attributes=F.array_join("attributes", "\n"), docstring=F.coalesce(F.substring("doc_comment", 1, 500), F.lit("")))
    constants = as_map(constant_name=F.col("name"), type_annotation=F.coalesce("type_annotation", F.lit("")), value=F.substring("value", 1, 200), line_number=line)
    kind = F.when(item, F.concat(F.lit("rust_"), F.col("kind"))).otherwise("rust_const")
    return found.select(content.alias("content"), F.col("file_path").alias("source"), F.lit(None).cast("string").alias("fork"), F.col("name").alias("section"), kind.alias("chunk_type"), F.when(item, items).otherwise(constants).alias("metadata"), F.col("client").alias("repo"), "ordinal")


def client_chunks(extracted: DataFrame, most: int = 2000) -> DataFrame:
    """Chunks of extracted client code (``schemas.EXTRACTED``): items, then constants."""
    item = F.col("row_type") == "item"
    content = F.when(item, X.client_item_content(F.col("doc_comment"), F.col("signature"), F.col("body"), most)).otherwise(X.client_constant_content(F.col("doc_comment"), F.col("name"), F.col("type_annotation"), F.col("value")))
    meta = F.create_map(F.lit("function_name"), F.when(item & (F.col("kind") == "function"), F.col("name")).otherwise(""), F.lit("client"), F.col("client"), F.lit("language"), F.col("language"), F.lit("line_number"), F.col("line_number").cast("string"), F.lit("visibility"), F.when(item, F.col("visibility")))
    return extracted.select(content.alias("content"), F.col("file_path").alias("source"), F.lit(None).cast("string").alias("fork"), F.col("name").alias("section"), F.when(item, X.client_item_type(F.col("kind"))).otherwise("client_constant").alias("chunk_type"), meta.alias("metadata"), F.col("client").alias("repo"), "ordinal")


def with_ids(chunks: DataFrame, project: Column | None = None, numbered: bool = False) -> DataFrame:
    """Adds chunk_id, numbered over all chunks of a (repo, source) in order. The path part hashes repo and source, so equal paths of two repositories differ.

    ``numbered`` says that ``ordinal`` counts a source's chunks from 0 already: then no row moves.
    """
    index = F.col("ordinal") if numbered else F.row_number().over(Window.partitionBy("repo", "source").orderBy("ordinal")) - 1
    own = project if project is not None else F.regexp_replace(F.coalesce(F.nullif(F.col("repo"), F.lit("")), F.lit("specs")), "[^A-Za-z0-9_-]", "-")
    return chunks.withColumn("chunk_id", X.chunk_id(own, F.col("chunk_type"), F.concat_ws("/", "repo", "source"), index, F.col("content")))


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, ids: bool = True, types: set[str] | None = None) -> DataFrame:
    """Chunks of files (path, file_type, repo, content); unknown types give none. ``types`` names the file types there are, if they are known: other routes are left out."""
    of = lambda *kinds: files.where(F.col("file_type").isin(*kinds))
    routes = {"spec": lambda x: spec_chunks(x, size, overlap), "eip": lambda x: eip_chunks(x, size, overlap), "builder": lambda x: builder_chunks(x, size, overlap), "pm": lambda x: notes_chunks(x, size, overlap), "lean": python_chunks}
    parts = [cut(of(kind)) for kind, cut in routes.items() if types is None or kind in types]
    if not parts or types is None or any(t.startswith("rust") for t in types):
        parts.append(rust_chunks(files.where(F.startswith("file_type", F.lit("rust")))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return with_ids(out, numbered=True) if ids else out


def id_of(project: str, kind: str, source: str, index: int, content: str) -> str:
    """A chunk id for one row on the driver, the same as the column expression's."""
    part = lambda t: hashlib.sha256(t.encode()).hexdigest()[:8]
    return f"{project}_{kind}_{part(source)}_{index:04d}_{part(content)}"


def to_records(chunks: DataFrame, vector: Column | None = None) -> DataFrame:
    """Chunks flattened to ``schemas.RECORD``. A null fork or section becomes empty; a metadata key that is absent becomes empty, one that is null stays null."""
    flat = lambda k: F.when(F.map_contains_key("metadata", F.lit(k)), F.element_at("metadata", k)).otherwise("").alias(k)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    made = (vector if vector is not None else F.lit(None).cast("array<float>")).alias("vector")
    more = [flat(k) for k in ("eip", "title", "function_name", "h1", "h2", "h3", "client", "language", "signature", "visibility", "constant_name")]
    return chunks.select("chunk_id", "content", "source", "repo", blank("fork"), blank("section"), "chunk_type", made, *more)

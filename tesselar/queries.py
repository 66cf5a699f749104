"""Registered queries over the driver's tables, each with the same in SQL where SQL can say it.

Texts shaped like specs, code or manifests are derived from ``documents`` by equal
expressions on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog, cli, schemas
from .functions import text as X
from .functions import vectors as VX
from .functions.lineage import shared
from .operators import chunking as K
from .operators import clients as CL
from .operators import constants as CV
from .operators import specs as SP
from .operators.longfiles import long_pieces
from .operators.pycode import python_rows
from .operators.splitting import by_headers, by_size
from .plans import api, cells, grams, incremental, quantised, search, validation
from .plans.manifest import Manifest, needs_rebuild, violations
from .plans.store import ChunkTable
from .sources import files as S
from .sources.files import hashes
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _of(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# --- vector search (J6, R1-R7, P25, P28) ---------------------------------------

_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
_SCORE = f"list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR})"


def _first_vector(rows: DataFrame) -> list[float]:
    return [float(x) for x in rows.orderBy("vec_id").first()["embedding"]]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("r1_vector_topk", f"SELECT vec_id, label, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 50")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return _hits(search.search(e, _first_vector(e), 50, key="vec_id", vector="embedding"))


@query("r3_vector_topk_prefilter", f"SELECT vec_id, label, round({_SCORE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_SCORE} DESC, vec_id LIMIT 20")
def vector_prefilter(spark, d):
    e = table(spark, d, "embeddings")
    return _hits(search.search(e, _first_vector(e), 20, F.col("label") == 3, key="vec_id", vector="embedding"))


@query("r3_vector_overfetch_postfilter", f"SELECT vec_id, label, score FROM (SELECT vec_id, label, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 40) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def vector_postfilter(spark, d):
    e = table(spark, d, "embeddings")
    return _hits(search.search(e, _first_vector(e), 20, F.col("label") == 3, 2, False, "vec_id", "embedding"))


@query("r4_vector_overfetch_three", f"SELECT vec_id, label, score FROM (SELECT vec_id, label, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 60) WHERE label IN (1, 2, 5) ORDER BY score DESC, vec_id LIMIT 20")
def vector_postfilter_three(spark, d):
    e = table(spark, d, "embeddings")
    return _hits(search.search(e, _first_vector(e), 20, F.col("label").isin(1, 2, 5), 3, False, "vec_id", "embedding"))


@query("r2_vector_topk_batch", """
WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_batch(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return search.batch_search(e, queries, 5, "embedding", "vec_id").withColumn("score", F.round("score", 6))


_LEGS = f"""
WITH s AS (SELECT vec_id, 's' || (vec_id % 17) AS source, 'h' || (label % 3) AS section, label, {_SCORE} AS score FROM embeddings),
a AS (SELECT *, 0 AS leg FROM s WHERE label < 5 ORDER BY score DESC, vec_id::VARCHAR LIMIT 40),
b AS (SELECT *, 1 AS leg FROM s WHERE label >= 3 ORDER BY score DESC, vec_id::VARCHAR LIMIT 40),
u AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY score DESC, vec_id::VARCHAR) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
f AS (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY leg, rank) AS n FROM u)
SELECT vec_id, source, section, round(score, 6) AS score, leg FROM f WHERE n = 1 ORDER BY score DESC, leg, rank LIMIT 25"""


@query("r5_r6_r7_merge_dedupe_rank", _LEGS)
def merge_legs(spark, d):
    e = table(spark, d, "embeddings")
    q = _first_vector(e)
    rows = e.select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), _of("s", (F.col("vec_id") % 17).cast("string")).alias("source"), _of("h", (F.col("label") % 3).cast("string")).alias("section"), "label", "embedding")
    legs = [search.search(rows, q, 40, w, vector="embedding").select("vec_id", "chunk_id", "source", "section", "score") for w in (F.col("label") < 5, F.col("label") >= 3)]
    return search.merge_legs(legs, 25).select("vec_id", "source", "section", F.round("score", 6).alias("score"), "leg")


_ASKED = "the reason of that and with for the"


@query("p28_hash_embed_search", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
v AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {VX.DIMENSIONS} AS pos, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
qt AS (SELECT unnest(regexp_extract_all('{_ASKED}', '[a-z0-9_]+')) AS t),
q AS (SELECT ('0x' || substr(md5(t), 1, 8))::BIGINT % {VX.DIMENSIONS} AS pos, count(*)::DOUBLE AS n FROM qt GROUP BY ALL),
s AS (SELECT doc_id, sum(v.n * coalesce(q.n, 0)) / (sqrt(sum(v.n * v.n)) * (SELECT sqrt(sum(n * n)) FROM q)) AS score FROM v LEFT JOIN q USING (pos) GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 20""")
def hash_embed_search(spark, d):
    terms = VX.sparse_terms(docs(spark, d), "doc_id", F.col("text"))
    weights: dict[int, float] = {}
    for t in VX.tokens(_ASKED):
        weights[VX.slot(t)] = weights.get(VX.slot(t), 0.0) + 1
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("at").cast("int")), F.lit(0.0))
    size = VX.norm(list(weights.values()))
    scored = terms.groupBy("doc_id").agg((F.sum(F.col("n") * weight) / (F.sqrt(F.sum(F.col("n") * F.col("n"))) * size)).alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


# --- scalar operators (P) --------------------------------------------------------

_FORK = "['phase0','altair','bellatrix','capella','deneb','electra','fulu','gloas']"


def _fork() -> Column:
    return F.get(F.array(*map(F.lit, X.PATH_FORKS)), (F.col("doc_id") % 8).cast("int"))


def _path() -> Column:
    return _of("consensus-specs/specs/", _fork(), "/f", _id(), ".md")


_PATH = f"('consensus-specs/specs/' || {_FORK}[doc_id % 8 + 1] || '/f' || doc_id || '.md')"


@query("p1_t25_chunk_ids", "SELECT doc_id, 'docs_' || lang || '_' || substr(sha256(source), 1, 8) || '_' || printf('%04d', row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) || '_' || substr(sha256(text), 1, 8) AS chunk_id FROM documents")
def chunk_ids(spark, d):
    chunks = docs(spark, d).select("doc_id", F.lit(None).cast("string").alias("repo"), "source", F.col("lang").alias("chunk_type"), F.col("text").alias("content"), F.col("doc_id").alias("ordinal"))
    return K.with_ids(chunks, F.lit("docs")).select("doc_id", "chunk_id")


@query("p2_checked_chunk_ids", f"SELECT doc_id, 'docs_' || lang || '_' || substr(sha256({_PATH}), 1, 8) || '_' || printf('%04d', doc_id % 10000) || '_' || substr(sha256(text), 1, 8) AS chunk_id FROM documents")
def checked_ids(spark, d):
    return docs(spark, d).select("doc_id", X.checked_chunk_id(F.lit("docs"), F.col("lang"), _path(), F.col("doc_id") % 10000, F.col("text")).alias("chunk_id"))


@query("p3_p4_paths", f"SELECT doc_id, {_FORK}[doc_id % 8 + 1] AS fork, substr({_PATH}, 17) AS below FROM documents")
def paths(spark, d):
    return docs(spark, d).select("doc_id", X.fork_of_path(F.upper(_path())).alias("fork"), X.relative_path(_path(), "consensus-specs").alias("below"))


@query("p5_p6_path_and_id_rules", """
WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a/../b' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'C:x' WHEN 3 THEN 'a' || chr(10) || 'b' WHEN 4 THEN 'a/b' || doc_id ELSE source || '/' || lang END AS path FROM documents)
SELECT doc_id, CASE WHEN contains(path, '..') THEN 'traversal' WHEN starts_with(path, '/') THEN 'absolute' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'drive' WHEN regexp_matches(path, '[\n\r\t]') THEN 'control' END AS error,
       regexp_full_match(path, '[A-Za-z0-9_-]+') AND length(path) <= 200 AS is_id FROM p""")
def path_rules(spark, d):
    k = F.col("doc_id") % 6
    path = F.when(k == 0, "a/../b").when(k == 1, "/etc/x").when(k == 2, "C:x").when(k == 3, "a\nb").when(k == 4, _of("a/b", _id())).otherwise(_of(F.col("source"), "/", F.col("lang")))
    return docs(spark, d).select("doc_id", path.alias("path")).select("doc_id", X.path_error(F.col("path")).alias("error"), X.is_chunk_id(F.col("path")).alias("is_id"))


_VARIANT = r"""CASE doc_id % 5 WHEN 0 THEN text || chr(10) || 'def fn_' || doc_id || '(x):' WHEN 1 THEN '| `MAX_' || doc_id || '` | 1 |' || text WHEN 2 THEN 'class T' || doc_id || '(Container)' || chr(10) || text
WHEN 3 THEN 'POST `/eth/' || doc_id || chr(10) || text ELSE text END"""


def _variant() -> Column:
    k, t = F.col("doc_id") % 5, F.col("text")
    return F.when(k == 0, _of(t, "\ndef fn_", _id(), "(x):")).when(k == 1, _of("| `MAX_", _id(), "` | 1 |", t)).when(k == 2, _of("class T", _id(), "(Container)\n", t)).when(k == 3, _of("POST `/eth/", _id(), "\n", t)).otherwise(t)


@query("p7_p8_chunk_types", rf"""
WITH v AS (SELECT doc_id, {_VARIANT} AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?m)^def\s+\w+\s*\(') THEN 'function' WHEN regexp_matches(t, '\|\s*`?[A-Z][A-Z0-9_]+`?\s*\|') THEN 'constant' WHEN regexp_matches(t, '(?m)^class\s+\w+') THEN 'type' ELSE 'spec' END AS spec_type,
       CASE WHEN regexp_matches(t, '(POST|GET|PUT|DELETE)\s+`?/') THEN 'builder_api' WHEN regexp_matches(t, 'class\s+\w+\s*\(Container\)') THEN 'builder_type' ELSE 'builder_spec' END AS builder_type FROM v""")
def chunk_types(spark, d):
    rows = docs(spark, d).select("doc_id", _variant().alias("t"))
    return rows.select("doc_id", X.spec_chunk_type(F.col("t")).alias("spec_type"), X.builder_chunk_type(F.col("t")).alias("builder_type"))


@query("p9_p10_frontmatter", "SELECT doc_id, doc_id::VARCHAR AS eip, source AS title, lang AS status, NULL::VARCHAR AS category, 3 AS keys, doc_id::VARCHAR AS number FROM documents")
def frontmatter(spark, d):
    rows = docs(spark, d).select("doc_id", _of("---\neip: ", _id(), "\ntitle: first\ntitle: ", F.col("source"), "\nnot a pair\nstatus:  ", F.col("lang"), " \n---\n", F.col("text")).alias("t"), _of("eip-", _id(), ".md").alias("file"))
    m = X.frontmatter(F.col("t"))
    return rows.select("doc_id", m.alias("m"), X.eip_number(F.col("file")).alias("number")).select("doc_id", *[F.element_at("m", k).alias(k) for k in ("eip", "title", "status", "category")], F.size("m").alias("keys"), "number")


@query("p11_section", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'unknown' END AS section FROM documents")
def sections(spark, d):
    k = F.col("doc_id") % 3
    return docs(spark, d).select("doc_id", X.section(F.when(k == 2, "").otherwise(F.col("source")), F.when(k == 0, F.col("lang")).when(k == 1, "")).alias("section"))


@query("p12_record_flattening", "SELECT doc_id, '' AS fork, source AS section, lang AS language, NULL::VARCHAR AS h1, '' AS eip FROM documents")
def flattening(spark, d):
    meta = F.create_map(F.lit("language"), F.col("lang"), F.lit("h1"), F.lit(None).cast("string"))
    chunks = docs(spark, d).select(_id().alias("chunk_id"), F.col("text").alias("content"), "source", F.lit(None).cast("string").alias("fork"), F.col("source").alias("section"), F.lit("spec").alias("chunk_type"), meta.alias("metadata"), F.lit("r").alias("repo"))
    return K.to_records(chunks).select(F.col("chunk_id").cast("bigint").alias("doc_id"), "fork", "section", "language", "h1", "eip")


@query("p13_p18_contents", """
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '// ' || source || chr(10) ELSE '' END || 'fn f()' || chr(10) || CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '// ... truncated ...' ELSE text END) AS client_item,
       CASE WHEN doc_id % 2 = 0 THEN '// ' || source || chr(10) ELSE '' END || 'const N: ' || lang || ' = ' || n_chars AS client_constant,
       md5(CASE WHEN doc_id % 2 = 0 THEN '/// ' || source || chr(10) ELSE '' END || '#[a]' || chr(10) || CASE WHEN length(text) > 3000 THEN substr(text, 1, 2500) || chr(10) || '// ... (truncated)' ELSE text END) AS rust_item,
       'const N = ' || n_chars || ';' AS rust_constant,
       length(CASE WHEN length(text) > 3000 THEN substr(text, 1, 2500) || chr(10) || '    # ... (truncated)' ELSE text END) AS class_chars,
       length(CASE WHEN length(text) > 2000 THEN substr(text, 1, 1800) || chr(10) || '    # ... (truncated)' ELSE text END) AS function_chars FROM documents""")
def contents(spark, d):
    doc, n = F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("n_chars").cast("string")
    none = F.lit(None).cast("string")
    return docs(spark, d).select(
        "doc_id", F.md5(X.client_item_content(doc, F.lit("fn f()"), F.col("text"))).alias("client_item"), X.client_constant_content(doc, F.lit("N"), F.col("lang"), n).alias("client_constant"),
        F.md5(X.rust_item_content(doc, F.array(F.lit("#[a]")), F.col("text"))).alias("rust_item"), X.rust_constant_content(none, F.lit("N"), none, n).alias("rust_constant"),
        F.length(X.cut_class(F.col("text"))).cast("bigint").alias("class_chars"), F.length(X.cut_function(F.col("text"))).cast("bigint").alias("function_chars"),
    )


@query("p19_constant_names", "SELECT DISTINCT w AS name, upper(w) = w AND lower(w) <> w AS is_constant FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def constant_names(spark, d):
    return docs(spark, d).select(F.explode(F.split("text", " ")).alias("name")).distinct().select("name", X.is_constant_name(F.col("name")).alias("is_constant"))


@query("p20_file_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_hashes(spark, d):
    return hashes(docs(spark, d).select(_id().alias("path"), F.col("text").alias("content"))).select(F.col("path").cast("bigint").alias("doc_id"), "sha256")


_REPO_ROWS = ", ".join(f"({i}, '{r}', '{u}', '{b}')" for i, (r, u, b) in enumerate(catalog.REPOS))


@query("p22_p23_j4_github_urls", f"""
WITH r(i, repo, url, branch) AS (VALUES {_REPO_ROWS}),
s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'EIPs' ELSE 'none' END AS repo, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/data/leanSig/src/' || doc_id || '.rs' ELSE 'a/' || doc_id || '.md' END AS source FROM documents)
SELECT s.doc_id, CASE WHEN source = '' THEN NULL WHEN r.url IS NOT NULL THEN r.url || '/blob/' || r.branch || '/' || source
  WHEN source LIKE '/data/leanSig/%' THEN (SELECT url || '/blob/' || branch || '/' FROM r WHERE repo = 'leanSig') || 'src/' || s.doc_id || '.rs' END AS github_url FROM s LEFT JOIN r ON r.repo = s.repo""")
def github_urls(spark, d):
    k = F.col("doc_id") % 4
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "EIPs").otherwise("none").alias("repo"), F.when(k == 0, "").when(k == 1, _of("/data/leanSig/src/", _id(), ".rs")).otherwise(_of("a/", _id(), ".md")).alias("source"))
    return search.github_url(rows, catalog.repos(spark)).select("doc_id", "github_url")


@query("p29_preview", "SELECT doc_id, substr(text, 1, 500) AS preview, printf('%.3f', quality::DOUBLE / 3) AS score FROM documents JOIN labels USING (doc_id)")
def previews(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", X.preview(F.col("text")).alias("preview"), X.shown_score(F.col("quality").cast("double") / 3).alias("score"))


# --- chunking and extraction (T) ---------------------------------------------------


@query("t1_markdown_sections", r"SELECT doc_id, source AS h1, lang AS h2, NULL::VARCHAR AS h3, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS content FROM documents WHERE regexp_matches(text, '\S')")
def markdown_sections(spark, d):
    rows = docs(spark, d).select("doc_id", _of("# ", F.col("source"), "\n## ", F.col("lang"), "\n", F.col("text")).alias("text"))

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            found = [(i, *s) for i, t in zip(pdf.doc_id, pdf.text, strict=True) for s in by_headers(t)]
            yield pd.DataFrame(found, columns=["doc_id", "h1", "h2", "h3", "content"])

    return rows.mapInPandas(cut, "doc_id bigint, h1 string, h2 string, h3 string, content string").withColumn("content", F.md5("content"))


@query("t2_lines", "SELECT doc_id, i::INT AS line, string_split(text, chr(10))[i + 1] AS content FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)")
def lines(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def _size_split(rows: DataFrame) -> DataFrame:
    def cut(batches):
        import pandas as pd

        for pdf in batches:
            found = [(i, n, p, len(p)) for i, t in zip(pdf.doc_id, pdf.text, strict=True) for n, p in enumerate(by_size(t or "", K.CHUNK_SIZE, K.CHUNK_OVERLAP))]
            yield pd.DataFrame(found, columns=["doc_id", "sub_chunk", "content", "n_chars"])

    return rows.select("doc_id", "text").mapInPandas(cut, "doc_id bigint, sub_chunk int, content string, n_chars int")


@query("t2_size_split")
def size_split(spark, d):
    return _size_split(docs(spark, d))


_LINES = "(SELECT doc_id, (doc_id % 60 + 1)::INT AS m FROM documents)"


@query("t2_sized_lines", f"""
WITH p AS (SELECT doc_id, m, unnest(range(CASE WHEN m <= 10 THEN 1 ELSE 1 + (m - 3) // 8 END)) AS i FROM {_LINES})
SELECT doc_id, i::INT AS sub_chunk, md5(array_to_string(list_transform(range(8 * i, least(8 * i + 10, m)), lambda k: lpad(doc_id || ':' || k, 99, 'x')), chr(10))) AS content FROM p""")
def sized_lines(spark, d):
    """Lines of 99 code points: ten fit a piece of 1000, and two of them the overlap of 200."""
    line = lambda k: F.lpad(F.concat_ws(":", _id(), k.cast("string")), 99, "x")
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 60), line), "\n")
    return _size_split(docs(spark, d).select("doc_id", text.alias("text"))).select("doc_id", "sub_chunk", F.md5("content").alias("content"))


@query("t1_t2_long_files", f"""
WITH d AS (SELECT doc_id, source, (doc_id % 60 + 1)::INT AS m FROM documents WHERE source IS NOT NULL), p AS (SELECT *, unnest(range(CASE WHEN m <= 15 THEN 1 ELSE 1 + (m - 3) // 8 END)) AS i FROM d)
SELECT source || '.md' AS path, 'D' || doc_id AS h1, CASE WHEN m > 15 THEN i::INT END AS sub_chunk,
  md5(array_to_string(list_transform(range(CASE WHEN m > 15 THEN 8 * i ELSE 0 END, CASE WHEN m > 15 THEN least(8 * i + 10, m) ELSE m END), lambda k: lpad(doc_id || ':' || k, 99, 'x')), chr(10))) AS content FROM p""")
def long_files(spark, d):
    """One file a source, with a section for each of its documents, split by ranges of 64 KiB that cut sections anywhere."""
    line = lambda k: F.lpad(F.concat_ws(":", _id(), k.cast("string")), 99, "x")
    text = _of("# D", _id(), "\n", F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 60), line), "\n"), "\n")
    rows = docs(spark, d).where("source is not null").select("source", "doc_id", text.alias("content"))
    places = rows.select("source", "doc_id", F.octet_length("content").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    root = S.tree_path(shared_folder(spark))
    S.write_parts(rows.join(places.withColumn("offset", before), ["source", "doc_id"]).select(_of(F.col("source"), ".md").alias("path"), "content", "offset"), root)
    return long_pieces(S.tree(spark, root), 1000, 200, 1 << 16).select("path", "h1", "sub_chunk", F.md5("content").alias("content"))


def _short_file() -> Column:
    return _of("# ", F.col("source"), "\n\n| Name | Value |\n| - | - |\n| `MAX_", _id(), "` | `1` |\n\n## ", F.col("lang"), "\n", F.md5("text"), "\n\n```python\ndef fn_", _id(), "(x):\n    return x\n```\n\n```python\nclass T(Container):\n    pass\n```\n")


_SHORT_CHUNKS = f"""
WITH f AS (SELECT doc_id, ['spec', 'eip', 'builder', 'pm', 'other'][doc_id % 5 + 1] AS kind, {_PATH} AS source, {_FORK}[doc_id % 8 + 1] AS fork, source AS h1, lang AS h2,
  '| Name | Value |' || chr(10) || '| - | - |' || chr(10) || '| `MAX_' || doc_id || '` | `1` |' AS one, 'def fn_' || doc_id || '(x):' || chr(10) || '    return x' AS fn, md5(text) AS m FROM documents),
b AS (SELECT *, m || chr(10) || chr(10) || '```python' || chr(10) || fn || chr(10) || '```' || chr(10) || chr(10) || '```python' || chr(10) || 'class T(Container):' || chr(10) || '    pass' || chr(10) || '```' AS two FROM f),
c AS (SELECT doc_id, kind, source, fork, 0 AS i, h1 AS section, CASE kind WHEN 'spec' THEN 'constant' WHEN 'builder' THEN 'builder_spec' ELSE kind END AS chunk_type, one AS content FROM b WHERE kind <> 'other'
  UNION ALL SELECT doc_id, kind, source, fork, 1, h2, CASE kind WHEN 'spec' THEN 'function' WHEN 'builder' THEN 'builder_type' ELSE kind END, two FROM b WHERE kind <> 'other'
  UNION ALL SELECT doc_id, kind, source, fork, 2, 'fn_' || doc_id, 'function', fn FROM b WHERE kind = 'spec')
SELECT 'consensus-specs_' || chunk_type || '_' || substr(sha256('consensus-specs/' || source), 1, 8) || '_000' || i || '_' || substr(sha256(content), 1, 8) AS chunk_id, source, CASE WHEN kind = 'spec' THEN fork END AS fork, section, chunk_type, content FROM c"""


def _short_files(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.get(F.array(*map(F.lit, ("spec", "eip", "builder", "pm", "other"))), (F.col("doc_id") % 5).cast("int"))
    return docs(spark, d).select(_path().alias("path"), kinds.alias("file_type"), F.lit("consensus-specs").alias("repo"), _short_file().alias("content"))


@query("t3_t4_t22_t23_t25_short_files", _SHORT_CHUNKS)
def short_files(spark, d):
    return K.chunk_files(_short_files(spark, d)).select("chunk_id", "source", "fork", "section", "chunk_type", "content")


def _spec_file() -> Column:
    return _of("# ", F.col("source"), "\n\n| Name | Value |\n| - | - |\n| `MAX_", (F.col("doc_id") % 50).cast("string"), "` | `", F.col("n_chars").cast("string"), "` |\n\n## ", F.col("lang"), "\n", F.col("text"), "\n\n```python\ndef fn_", _id(), "(x):\n    return x\n```\n\n```python\nclass T", (F.col("doc_id") % 20).cast("string"), "(Container):\n    pass\n```\n")


def _files(spark: SparkSession, d: str, kind: str = "spec") -> DataFrame:
    return docs(spark, d).select("doc_id", _path().alias("path"), F.lit(kind).alias("file_type"), F.lit("consensus-specs").alias("repo"), _fork().alias("fork"), _spec_file().alias("content"))


@query("t3_t4_t22_chunks")
def chunk_table(spark, d):
    rows = _files(spark, d)
    kinds = F.get(F.array(*map(F.lit, ("spec", "eip", "builder", "pm", "other"))), (F.col("doc_id") % 5).cast("int"))
    return K.chunk_files(rows.withColumn("file_type", kinds).drop("doc_id", "fork")).select("chunk_id", "source", "fork", "section", "chunk_type", "ordinal", "content")


@query("t5_function_blocks", "SELECT doc_id, 'fn_' || doc_id AS section, 'def fn_' || doc_id || '(x):' || chr(10) || '    return x' AS content, 'function' AS chunk_type FROM documents")
def function_blocks(spark, d):
    found = K.function_chunks(_files(spark, d).withColumn("path", _id()))
    return found.select(F.col("source").cast("bigint").alias("doc_id"), "section", "content", "chunk_type")


@query("t6_t10_python", """
WITH r AS (SELECT doc_id, unnest([
  {'ordinal': 0, 'section': doc_id::VARCHAR, 'chunk_type': 'lean_doc', 'line_number': NULL, 'signature': NULL},
  {'ordinal': 1, 'section': 'MAX_' || doc_id, 'chunk_type': 'lean_constant', 'line_number': '2', 'signature': NULL},
  {'ordinal': 2, 'section': 'C' || doc_id, 'chunk_type': 'lean_class', 'line_number': '4', 'signature': NULL},
  {'ordinal': 3, 'section': 'C' || doc_id || '.get', 'chunk_type': 'lean_function', 'line_number': '6', 'signature': 'def get(self, n: int) -> int:'},
  {'ordinal': 4, 'section': 'run', 'chunk_type': 'lean_function', 'line_number': '8', 'signature': 'async def run(a):'}]) AS x FROM documents)
SELECT doc_id, x.ordinal::INT AS ordinal, x.section AS section, x.chunk_type AS chunk_type, x.line_number::VARCHAR AS line_number, x.signature::VARCHAR AS signature FROM r""")
def python_code(spark, d):
    code = _of('"""Module."""\nMAX_', _id(), ": int = 7\n@dec\nclass C", _id(), "(Base, a.B):\n    x = 1\n    def get(self, n: int) -> int:\n        return n\nasync def run(a):\n    pass\n")
    found = K.python_chunks(docs(spark, d).select(_id().alias("path"), F.lit("r").alias("repo"), code.alias("content")))
    m = lambda k: F.element_at("metadata", k).alias(k)
    return found.select(F.col("source").cast("bigint").alias("doc_id"), "ordinal", "section", "chunk_type", m("line_number"), m("signature"))


def _extracted_sql(rows: list[str]) -> str:
    made = ", ".join("{" + r + "}" for r in rows)
    return f"WITH r AS (SELECT doc_id, unnest([{made}]) AS x FROM documents) SELECT doc_id, x.ordinal::INT AS ordinal, x.row_type AS row_type, x.kind AS kind, x.name AS name, x.signature AS signature, x.value::VARCHAR AS value, x.doc::VARCHAR AS doc_comment, x.line::INT AS line_number FROM r"


def _row(ordinal: int, row_type: str, kind: str, name: str, signature: str, value: str, doc: str, line: int) -> str:
    return f"'ordinal': {ordinal}, 'row_type': '{row_type}', 'kind': '{kind}', 'name': {name}, 'signature': {signature}, 'value': {value}, 'doc': {doc}, 'line': {line}"


def _code(spark: SparkSession, d: str, code: Column, rules: str, language: str) -> DataFrame:
    found = K.extract(docs(spark, d).select(_id().alias("path"), code.alias("content")), rules, F.lit("c"), F.lit(language))
    return found.select(F.col("file_path").cast("bigint").alias("doc_id"), "ordinal", "row_type", "kind", "name", "signature", "value", "doc_comment", "line_number")


def _rust() -> Column:
    return _of("/// adds\n#[inline]\npub fn f", _id(), "(a: u64) -> u64 { if a > 0 { a } else { 0 } }\nfn hidden() {}\n\npub struct S", _id(), " { x: u64 }\npub enum E { A }\npub const MAX: u64 = ", _id(), ";\nconst LOW: u8 = 1;\n")


_RUST = [_row(0, "item", "function", "'f' || doc_id", "'fn f' || doc_id || '(a: u64) -> u64'", "NULL", "'adds'", 3), _row(1, "item", "struct", "'S' || doc_id", "'struct S' || doc_id", "NULL", "NULL", 6)]


@query("t12_rust", _extracted_sql([*_RUST, _row(2, "item", "enum", "'E'", "'enum E'", "NULL", "NULL", 7), _row(3, "constant", "const", "'MAX'", "''", "doc_id::VARCHAR", "NULL", 8)]))
def rust_code(spark, d):
    return _code(spark, d, _rust(), "rust_spec", "rust")


@query("t13_rust_clients", _extracted_sql([*_RUST, _row(2, "constant", "const", "'MAX'", "''", "doc_id::VARCHAR", "NULL", 8), _row(3, "constant", "const", "'LOW'", "''", "'1'", "NULL", 9)]))
def rust_client_code(spark, d):
    return _code(spark, d, _rust(), "rust", "rust")


@query("t11_t18_rust_tree")
def rust_tree(spark, d):
    code = _of(_rust(), "impl S", _id(), " {\n    /// gets }\n    #[must_use]\n    pub fn get(&self) -> u64 { self.x }\n}\n")
    return K.with_ids(K.rust_chunks(docs(spark, d).select(_id().alias("path"), F.lit("leanSig").alias("repo"), code.alias("content"))))


def _items_sql(rows: list[str]) -> str:
    return f"WITH r AS (SELECT doc_id, unnest([{', '.join('{' + r + '}' for r in rows)}]) AS x FROM documents) SELECT doc_id, x.ordinal::INT AS ordinal, x.kind AS kind, x.name AS name, x.signature AS signature, x.body AS body, x.value::VARCHAR AS value, x.doc::VARCHAR AS doc_comment, x.line::INT AS line_number, x.visibility AS visibility, x.attributes AS attributes FROM r"


def _item(ordinal: int, kind: str, name: str, signature: str, body: str, value: str, doc: str, line: int, visibility: str, attributes: str) -> str:
    return f"'ordinal': {ordinal}, 'kind': '{kind}', 'name': {name}, 'signature': {signature}, 'body': {body}, 'value': {value}, 'doc': {doc}, 'line': {line}, 'visibility': '{visibility}', 'attributes': '{attributes}'"


_GET = "'    pub fn get(&self) -> u64 { self.x }'"


@query("t11_t16_t18_rust_items", _items_sql([
    _item(0, "function", "'f' || doc_id", "'fn f' || doc_id || '(a: u64) -> u64'", "'pub fn f' || doc_id || '(a: u64) -> u64 { if a > 0 { a } else { 0 } }'", "NULL", "'adds'", 3, "pub", "#[inline]"),
    _item(1, "struct", "'S' || doc_id", "'struct S' || doc_id", "'pub struct S' || doc_id || ' { x: u64 }'", "NULL", "NULL", 6, "pub", ""),
    _item(2, "enum", "'E'", "'enum E'", "'pub enum E { A }'", "NULL", "NULL", 7, "pub", ""),
    _item(3, "impl", "'S' || doc_id", "'impl S' || doc_id", "'impl S' || doc_id || ' {' || chr(10) || '    /// gets }' || chr(10) || '    #[must_use]' || chr(10) || " + _GET + " || chr(10) || '}'", "NULL", "NULL", 10, "private", ""),
    _item(4, "function", "'get'", "'fn get(&self) -> u64'", _GET, "NULL", "'gets }'", 13, "pub", "#[must_use]"),
    _item(5, "const", "'MAX'", "''", "''", "doc_id::VARCHAR", "NULL", 8, "pub", ""),
    _item(6, "const", "'LOW'", "''", "''", "'1'", "NULL", 9, "private", "")]))
def rust_items(spark, d):
    code = _of(_rust(), "impl S", _id(), " {\n    /// gets }\n    #[must_use]\n    pub fn get(&self) -> u64 { self.x }\n}\n")
    found = K.extract(docs(spark, d).select(_id().alias("path"), code.alias("content")), "rust_tree", aware=True)
    return found.select(F.col("file_path").cast("bigint").alias("doc_id"), "ordinal", "kind", "name", "signature", "body", "value", "doc_comment", "line_number", "visibility", F.array_join("attributes", ",").alias("attributes"))


@query("t11_t16_nested_rust", _items_sql([
    _item(0, "function", "'f' || doc_id", "'fn f' || doc_id || '(x: [u8; { 2 }]) -> Vec<Vec<u8>>'", """'pub fn f' || doc_id || '(x: [u8; { 2 }]) -> Vec<Vec<u8>> { let s = r#"}"#; /* { /* } */ */ const IN' || doc_id || ': u8 = 1; x }'""", "NULL", "'doc ' || doc_id", 4, "pub", "#[inline]").replace("'line': 4", "'line': 4 + doc_id % 3"),
    _item(1, "struct", "'S' || doc_id", "'struct S' || doc_id", "'pub struct S' || doc_id || '<T: A<B>> { a: T }'", "NULL", "NULL", 5, "pub", "").replace("'line': 5", "'line': 5 + doc_id % 3"),
    _item(2, "impl", "'Tr for S' || doc_id || '<T>'", "'impl <T> Tr for S' || doc_id || '<T>'", "'impl<T> Tr for S' || doc_id || '<T> { }'", "NULL", "NULL", 6, "private", "").replace("'line': 6", "'line': 6 + doc_id % 3"),
    _item(3, "const", "'IN' || doc_id", "''", "''", "'1'", "'doc ' || doc_id", 4, "private", "#[inline]").replace("'line': 4", "'line': 4 + doc_id % 3"),
    _item(4, "const", "'C' || doc_id", "''", "''", "'{ ' || doc_id || ' }'", "NULL", 7, "private", "").replace("'line': 7", "'line': 7 + doc_id % 3")]))
def nested_rust(spark, d):
    """Items in up to three modules, with raw strings, nested comments, generics and braces in types; every fifth source is cut off after them, within its modules."""
    deep = (F.col("doc_id") % 3).cast("int")
    close = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.repeat(F.lit("}"), deep + 1))
    code = _of("mod m", _id(), " {\n", F.repeat(F.lit("mod n {\n"), deep), "/// doc ", _id(), "\n#[inline]\npub fn f", _id(), "(x: [u8; { 2 }]) -> Vec<Vec<u8>> { let s = r#\"}\"#; /* { /* } */ */ const IN", _id(), ": u8 = 1; x }\npub struct S", _id(), "<T: A<B>> { a: T }\nimpl<T> Tr for S", _id(), "<T> { }\nconst C", _id(), ": u8 = { ", _id(), " };\nmacro_rules! q { () => { pub fn no() {} } }\n", close)
    found = K.extract(docs(spark, d).select(_id().alias("path"), code.alias("content")), "rust_tree")
    return found.select(F.col("file_path").cast("bigint").alias("doc_id"), "ordinal", "kind", "name", "signature", "body", "value", "doc_comment", "line_number", "visibility", F.array_join("attributes", ",").alias("attributes"))


@query("t10_source_segments", """
WITH r AS (SELECT doc_id, unnest([{'i': 1, 'c': 'MAX_' || doc_id || ': int = 7'}, {'i': 2, 'c': 'class C' || doc_id || '(Base, a.B):' || chr(10) || '    x = 1' || chr(10) || '    def get(self, n: int) -> int:' || chr(10) || '        return n'},
  {'i': 3, 'c': '    def get(self, n: int) -> int:' || chr(10) || '        return n'}, {'i': 4, 'c': 'async def run(a):' || chr(10) || '    pass'}]) AS x FROM documents)
SELECT doc_id, x.i::INT AS ordinal, x.c AS content FROM r""")
def source_segments(spark, d):
    code = _of('"""Module."""\nMAX_', _id(), ": int = 7\n@dec\nclass C", _id(), "(Base, a.B):\n    x = 1\n    def get(self, n: int) -> int:\n        return n\nasync def run(a):\n    pass\n")
    found = K.python_chunks(docs(spark, d).select(_id().alias("path"), F.lit("r").alias("repo"), code.alias("content")))
    return found.where("ordinal > 0").select(F.col("source").cast("bigint").alias("doc_id"), "ordinal", "content")


@query("t14_go", _extracted_sql([
    _row(0, "item", "function", "'Run' || doc_id", "'func Run' || doc_id || '(n int) error'", "NULL", "'Run runs'", 3), _row(1, "item", "struct", "'S'", "'type S struct'", "NULL", "NULL", 7), _row(2, "item", "interface", "'I'", "'type I interface'", "NULL", "NULL", 8),
    _row(3, "constant", "const", "'Max'", "''", "doc_id::VARCHAR", "NULL", 10), _row(4, "constant", "const", "'One'", "''", "'1'", "NULL", 13)]))
def go_code(spark, d):
    code = _of("package p\n// Run runs\nfunc (r *R) Run", _id(), "(n int) error {\n\tif n > 0 { return nil }\n\treturn nil\n}\ntype S struct { A int }\ntype I interface { F() }\nconst (\n\tMax = ", _id(), "\n\tlow = 2\n)\nconst One = 1\n")
    return _code(spark, d, code, "go", "go")


@query("t15_java", _extracted_sql([
    _row(0, "item", "function", "'get' || doc_id", "'public int get' || doc_id || '(int a)'", "NULL", "'Gets.'", 7), _row(1, "item", "struct", "'A'", "'class A'", "NULL", "NULL", 2), _row(2, "constant", "const", "'MAX'", "''", "doc_id::VARCHAR", "NULL", 3)]))
def java_code(spark, d):
    code = _of("package p;\npublic final class A {\n  public static final int MAX = ", _id(), ";\n  /**\n   * Gets.\n   */\n  public int get", _id(), "(int a) {\n    if (a > 0) { return a; }\n    return 0;\n  }\n}\n")
    return _code(spark, d, code, "java", "java")


@query("t19_constants_table", "SELECT doc_id, 'MAX_' || (doc_id % 50) AS name, n_chars::VARCHAR AS value FROM documents")
def constants_table(spark, d):
    return _files(spark, d).select("doc_id", F.inline(SP.constant_cells(F.col("content"))))


@query("a5_constants_by_fork", f"WITH c AS (SELECT {_FORK}[doc_id % 8 + 1] AS fork, 'MAX_' || (doc_id % 50) AS name, n_chars::VARCHAR AS value, {_PATH} AS path FROM documents) SELECT fork, name, arg_max(value, path) AS value FROM c GROUP BY fork, name")
def constants_by_fork(spark, d):
    return SP.constants(_files(spark, d))


@query("t20_a6_names_by_fork", f"SELECT {_FORK}[doc_id % 8 + 1] AS fork, array_to_string(list_sort(list(DISTINCT 'fn_' || doc_id)), ',') AS functions, array_to_string(list_sort(list(DISTINCT 'T' || (doc_id % 20))), ',') AS types FROM documents GROUP BY 1")
def names_by_fork(spark, d):
    c = SP.compile_specs(_files(spark, d))
    return c.select("fork", F.array_join("functions", ",").alias("functions"), F.array_join("types", ",").alias("types"))


@query("k6_compiled_specs", f"""
WITH c AS (SELECT {_FORK}[doc_id % 8 + 1] AS fork, 'MAX_' || (doc_id % 50) AS name, n_chars::VARCHAR AS value, {_PATH} AS path FROM documents),
l AS (SELECT fork, name, arg_max(value, path) AS value FROM c GROUP BY fork, name)
SELECT fork, count(*) AS n_constants, array_to_string(list(name || '=' || value ORDER BY name), ',') AS constants FROM l GROUP BY fork""")
def compiled_specs(spark, d):
    c = SP.compile_specs(_files(spark, d))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("constants")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.select("fork", F.size("constants").cast("bigint").alias("n_constants"), shown.alias("constants"))


@query("s12_q3_grep_constant", f"WITH c AS (SELECT n_chars::VARCHAR AS value, {_PATH} AS path FROM documents WHERE doc_id % 50 = 5 AND doc_id % 8 = 5) SELECT 'electra' AS fork, 'MAX_5' AS name, arg_max(value, path) AS value, 'compiled' AS origin FROM c HAVING count(*) > 0")
def grep_constant(spark, d):
    return SP.grep_constant(SP.compile_specs(_files(spark, d)), "MAX_5", "electra")


_FORKS = ", ".join(f"'{f}'" for f in catalog.FORK_NAMES)


@query("t19_a5_constant_values", f"""
WITH RECURSIVE d AS (SELECT doc_id, [{_FORKS}][doc_id % 7 + 1] AS fork, 'K_' || doc_id AS name, 'K_' || (doc_id - 1) AS ref, doc_id % 5 = 0 AS own FROM documents),
v AS (SELECT doc_id, (1::BIGINT << (doc_id % 20)) AS value, NULL::VARCHAR AS error FROM d WHERE own
      UNION ALL SELECT d.doc_id, CASE WHEN v.error IS NULL AND d.doc_id % 7 <> 0 THEN v.value * 2 + d.doc_id % 3 END, CASE WHEN d.doc_id % 7 = 0 THEN 'unknown ' || ref WHEN v.error IS NOT NULL THEN 'needs ' || ref END FROM v JOIN d ON d.doc_id = v.doc_id + 1 WHERE NOT own)
SELECT fork, name, value::VARCHAR AS value, CASE WHEN own THEN 'uint64' END AS type, error FROM d JOIN v USING (doc_id)""")
def constant_values(spark, d):
    """Constants that refer to the document before theirs, in a fork that may be earlier (found), later or missing (unknown)."""
    i = F.col("doc_id")
    fork = F.get(F.array(*map(F.lit, catalog.FORK_NAMES)), (i % 7).cast("int"))
    own = _of("uint64(2**", (i % 20).cast("string"), ")")
    other = _of("K_", (i - 1).cast("string"), " * 2 + ", (i % 3).cast("string"))
    content = _of("| Name | Value |\n|-|-|\n| `K_", _id(), "` | `", F.when(i % 5 == 0, own).otherwise(other), "` |\n")
    files = docs(spark, d).select(fork.alias("fork"), _of("specs/", _id(), ".md").alias("path"), content.alias("content"))
    return CV.constant_values(files, catalog.FORK_NAMES).select("fork", "name", "value", "type", "error")


@query("q4_function_source", f"SELECT {_PATH} AS path, 'def fn_5(x):' || chr(10) || '    return x' || chr(10) AS source FROM documents WHERE doc_id = 5")
def function_source(spark, d):
    return SP.function_source(_files(spark, d), "fn_5", "electra")


# --- maintenance (J, A, M, K) --------------------------------------------------------

_A = "(SELECT 'd/' || doc_id AS path, sha256(text) AS sha256, doc_id * 10 AS mtime_ns, ['c' || doc_id, 'x' || doc_id] AS ids FROM documents WHERE doc_id % 7 <> 0)"
_B = "(SELECT 'd/' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS sha256, CASE WHEN doc_id % 3 = 0 THEN doc_id * 10 + 1 ELSE doc_id * 10 END AS mtime_ns FROM documents WHERE doc_id % 11 <> 0)"
_DIFF = f"""
WITH j AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' WHEN a.mtime_ns = b.mtime_ns OR a.sha256 = b.sha256 THEN NULL ELSE 'modify' END AS change_type, coalesce(a.ids, []) AS old
           FROM {_A} AS a FULL JOIN {_B} AS b ON a.path = b.path),
c AS (SELECT * FROM j WHERE change_type IS NOT NULL)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = docs(spark, d)
    path = _of("d/", _id()).alias("path")
    a = t.where("doc_id % 7 <> 0").select(path, F.sha2("text", 256).alias("sha256"), (F.col("doc_id") * 10).alias("mtime_ns"), F.array(_of("c", _id()), _of("x", _id())).alias("chunk_ids"))
    text = F.when(F.col("doc_id") % 5 == 0, _of(F.col("text"), "!")).otherwise(F.col("text"))
    b = t.where("doc_id % 11 <> 0").select(path, F.sha2(text, 256).alias("sha256"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 10 + 1).otherwise(F.col("doc_id") * 10).alias("mtime_ns"))
    return a, b


@query("j1_r8_manifest_diff", f"{_DIFF} SELECT path, change_type, array_to_string(old, ',') AS old_chunk_ids FROM c")
def manifest_diff(spark, d):
    a, b = _snapshots(spark, d)
    return incremental.compute_changes(b, a).withColumn("old_chunk_ids", F.array_join("old_chunk_ids", ","))


@query("j1_time_only_diff", f"SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS change_type FROM {_A} AS a FULL JOIN {_B} AS b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.mtime_ns <> b.mtime_ns")
def time_diff(spark, d):
    a, b = _snapshots(spark, d)
    return incremental.compute_changes(b, a, check_hashes=False).select("path", "change_type")


@query("a3_change_counts", f"{_DIFF} SELECT count(*) FILTER (change_type = 'add') AS files_added, count(*) FILTER (change_type = 'modify') AS files_modified, count(*) FILTER (change_type = 'delete') AS files_deleted, sum(len(old))::BIGINT AS chunks_deleted FROM c")
def change_counts(spark, d):
    a, b = _snapshots(spark, d)
    return incremental.change_counts(incremental.compute_changes(b, a))


@query("a4_dry_run_estimates", f"{_DIFF} SELECT sum(CASE WHEN change_type <> 'delete' THEN 10 ELSE 0 END)::BIGINT AS estimated_chunks_add, sum(CASE WHEN change_type <> 'add' THEN len(old) ELSE 0 END)::BIGINT AS estimated_chunks_delete FROM c")
def dry_run(spark, d):
    a, b = _snapshots(spark, d)
    return incremental.estimates(incremental.compute_changes(b, a))


@query("a2_manifest_totals", f"SELECT count(*) AS files, sum(len(ids))::BIGINT AS chunks FROM {_A}")
def manifest_totals(spark, d):
    a, _ = _snapshots(spark, d)
    return incremental.totals(a)


@query("m6_manifest_violations", "SELECT CASE WHEN doc_id % 4 = 0 THEN '/abs/' || doc_id ELSE 'd/' || doc_id END AS path, CASE WHEN doc_id % 4 = 0 THEN 'absolute' ELSE 'sha256' END AS rule FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1")
def manifest_violations(spark, d):
    k = F.col("doc_id") % 4
    rows = docs(spark, d).select(F.when(k == 0, _of("/abs/", _id())).otherwise(_of("d/", _id())).alias("path"), F.when(k == 1, "bad").otherwise(F.sha2("text", 256)).alias("sha256"), F.array(F.lit("c")).alias("chunk_ids"))
    return violations(rows)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared(spark)}/tesselar-store/{uuid.uuid4().hex}"


def _stored(rows: DataFrame) -> DataFrame:
    made = {"chunk_id": _of("c", _id()), "content": F.col("t"), "source": F.col("source"), "chunk_type": F.col("lang"), "vector": F.lit(None).cast("array<float>")}
    return rows.select(*[made.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in schemas.RECORD.fields])


@query("k1_k5_m4_store", """
SELECT 'c' || doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS content, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 2 ELSE 1 END AS commit FROM documents WHERE doc_id % 11 <> 0""")
def store(spark, d):
    t = docs(spark, d)
    new = t.withColumn("t", F.when(F.col("doc_id") % 5 == 0, _of(F.col("text"), "!")).otherwise(F.col("text")))
    chunks = ChunkTable(spark, shared_folder(spark))
    chunks.replace(_stored(t.where("doc_id % 7 <> 0").withColumn("t", F.col("text"))), 1)
    changed = (F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0)
    chunks.delete(t.where(changed | (F.col("doc_id") % 11 == 0)).select(_of("c", _id()).alias("chunk_id")), 2)
    chunks.append(_stored(new.where(changed & (F.col("doc_id") % 11 != 0))), 2)
    return chunks.live(2).select("chunk_id", "content", F.col("commit").cast("int").alias("commit"))


def _note_files(rows: DataFrame, text: Column, time: Column) -> DataFrame:
    """Rows of ``schemas.FILE``: a note of one chunk for each document."""
    made = {"path": _of("d/", _id(), ".md"), "abs_path": F.lit(""), "file_type": F.lit("pm"), "repo": F.lit("pm"), "mtime_ns": time, "content": _of("# ", F.col("source"), "\n\n", F.md5(text), "\n")}
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in schemas.FILE.fields])


def _updated(spark: SparkSession, d: str) -> tuple[incremental.Index, incremental.Result]:
    """An index of snapshot A, updated to snapshot B (see ``_A`` and ``_B``)."""
    t, index = docs(spark, d), incremental.Index(spark, shared_folder(spark))
    index.index(_note_files(t.where("doc_id % 7 <> 0"), F.col("text"), F.col("doc_id") * 10))
    text = F.when(F.col("doc_id") % 5 == 0, _of(F.col("text"), "!")).otherwise(F.col("text"))
    later = _note_files(t.where("doc_id % 11 <> 0"), text, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 10 + 1).otherwise(F.col("doc_id") * 10))
    return index, index.index(later)


@query("m2_m3_m4_k5_index", """
WITH f AS (SELECT doc_id, 'd/' || doc_id || '.md' AS source, md5(CASE WHEN doc_id % 5 = 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0) THEN text || '!' ELSE text END) AS content FROM documents WHERE doc_id % 11 <> 0)
SELECT source, content, 'pm_pm_' || substr(sha256('pm/' || source), 1, 8) || '_0000_' || substr(sha256(content), 1, 8) AS chunk_id FROM f""")
def index_lifecycle(spark, d):
    index, _ = _updated(spark, d)
    return index.live().select("source", "content", "chunk_id")


@query("m4_m9_update_stats", """
WITH s AS (SELECT count(*) FILTER (doc_id % 7 = 0 AND doc_id % 11 <> 0) AS added, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 15 = 0) AS modified, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 = 0) AS deleted, count(*) FILTER (doc_id % 11 <> 0) AS now FROM documents)
SELECT 'Incremental update: ' || added || ' added, ' || modified || ' modified, ' || deleted || ' deleted (' || (added + modified) || ' chunks added, ' || (modified + deleted) || ' deleted)' AS summary, (now - added - modified) AS files_unchanged FROM s""")
def update_stats(spark, d):
    _, stats = _updated(spark, d)
    return spark.createDataFrame([(stats.summary(), stats.same)], "summary string, files_unchanged bigint")


@query("s13_k5_manifest_entries", """
SELECT 'pm/d/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN doc_id * 10 + 1 ELSE doc_id * 10 END AS mtime_ns, 1 AS chunks, sha256('# ' || source || chr(10) || chr(10) || md5(CASE WHEN doc_id % 5 = 0 AND (doc_id % 3 = 0 OR doc_id % 7 = 0) THEN text || '!' ELSE text END) || chr(10)) AS sha256 FROM documents WHERE doc_id % 11 <> 0""")
def manifest_entries(spark, d):
    index, _ = _updated(spark, d)
    found, _ = index.manifest()
    return found.frame(spark).select("path", "mtime_ns", F.size("chunk_ids").alias("chunks"), "sha256")


@query("m4_stream_upkeep", """
WITH f AS (SELECT doc_id, 'd/' || doc_id || '.md' AS source, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content FROM documents WHERE doc_id % 11 <> 0)
SELECT source, content, 'pm_pm_' || substr(sha256('pm/' || source), 1, 8) || '_0000_' || substr(sha256(content), 1, 8) AS chunk_id FROM f""")
def stream_upkeep(spark, d):
    """An index kept by a stream: three runs of events (new files; changed ones with repeats and late events; new and vanished ones)."""
    t, folder = docs(spark, d), shared_folder(spark)
    new = F.when(F.col("doc_id") % 5 == 0, _of(F.col("text"), "!")).otherwise(F.col("text"))
    gone = lambda rows, is_gone: rows.withColumn("gone", F.lit(is_gone))
    first = gone(_note_files(t.where("doc_id % 7 <> 0"), F.col("text"), F.lit(10)), False)
    changed = gone(_note_files(t.where("doc_id % 7 <> 0 AND doc_id % 5 = 0"), new, F.lit(20)), False)
    late = gone(_note_files(t.where("doc_id % 7 <> 0 AND doc_id % 5 = 0"), F.reverse("text"), F.lit(5)), False)
    more = gone(_note_files(t.where("doc_id % 7 = 0"), new, F.lit(30)), False)
    lost = gone(_note_files(t.where("doc_id % 11 = 0"), F.col("text"), F.lit(40)), True)
    index = incremental.Index(spark, f"{folder}/index")
    for i, events in enumerate((first, changed.unionByName(changed).unionByName(late), more.unionByName(lost))):
        events.write.parquet(f"{folder}/events/run={i}")
        stream = spark.readStream.schema(ingest.EVENT).option("recursiveFileLookup", True).parquet(f"{folder}/events")
        ingest.upkeep(stream, index, f"{folder}/checkpoint").awaitTermination()
    return index.live().select("source", "content", "chunk_id")


@query("a1_table_count", "SELECT count(*) AS total_chunks, 'specs' AS \"table\" FROM documents WHERE doc_id % 11 <> 0")
def table_count(spark, d):
    index, _ = _updated(spark, d)
    return index.stats().select("total_chunks", "table")


def _clients(spark: SparkSession, d: str) -> DataFrame:
    client = F.when(F.col("doc_id") % 2 == 0, "reth").otherwise("lighthouse")
    return CL.compile_clients(docs(spark, d).select(_of("f", F.lpad(_id(), 9, "0")).alias("path"), _rust().alias("content"), client.alias("client"), F.lit("rust").alias("language")))


@query("a7_client_statistics", """
SELECT CASE WHEN doc_id % 2 = 0 THEN 'reth' ELSE 'lighthouse' END AS client, count(*) AS files, 2 * count(*) AS items, 2 * count(*) AS constants, count(*) AS functions, count(*) AS structs, 0::BIGINT AS interfaces FROM documents GROUP BY ROLLUP (client)""")
def client_statistics(spark, d):
    return CL.statistics(_clients(spark, d))


@query("k7_a8_name_index", """
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'reth' ELSE 'lighthouse' END AS client, 'f' || lpad(doc_id::VARCHAR, 9, '0') AS file FROM documents),
r AS (SELECT client, 'functions' AS category, 'f' || doc_id AS name, file, 3 AS line, NULL AS value FROM f UNION ALL SELECT client, 'structs', 'S' || doc_id, file, 6, NULL FROM f
      UNION ALL SELECT client, 'constants', 'MAX', max(file), 8, max(doc_id)::VARCHAR FROM f GROUP BY client UNION ALL SELECT client, 'constants', 'LOW', max(file), 9, '1' FROM f GROUP BY client)
SELECT * FROM r""")
def name_index(spark, d):
    return CL.name_index(_clients(spark, d))


@query("t24_client_chunks", """
WITH c AS (SELECT doc_id, unnest([{'t': 'client_function', 's': 'f' || doc_id, 'f': 'f' || doc_id}, {'t': 'client_struct', 's': 'S' || doc_id, 'f': ''}, {'t': 'client_constant', 's': 'MAX', 'f': ''}, {'t': 'client_constant', 's': 'LOW', 'f': ''}]) AS x FROM documents)
SELECT 'f' || lpad(doc_id::VARCHAR, 9, '0') AS source, x.s AS section, x.t AS chunk_type, x.f AS function_name FROM c""")
def client_chunks(spark, d):
    return K.client_chunks(_clients(spark, d)).select("source", "section", "chunk_type", F.element_at("metadata", "function_name").alias("function_name"))


@query("q18_rust_lookup", "SELECT 'f' || lpad('7', 9, '0') AS file_path, 'f7' AS name, 3 AS line_number FROM documents WHERE doc_id = 7")
def rust_lookup(spark, d):
    return CL.lookup(_clients(spark, d), "f7", kind="function").select("file_path", "name", "line_number")


@query("a10_a11_status_counts", "SELECT source, count(*) AS documents, count(*) FILTER (length(text) > 1500) AS split FROM documents GROUP BY source")
def status_counts(spark, d):
    return CL.counted(docs(spark, d), "source", F.length("text") > K.SPLIT_ABOVE).select("source", F.col("n").alias("documents"), F.col("passed").alias("split"))


@query("j8_type_sets", "SELECT label, count(*) AS n FROM embeddings WHERE label IN (1, 2, 5) GROUP BY label")
def type_sets(spark, d):
    return search.of_kinds(table(spark, d, "embeddings"), (1, 2, 5), "label").groupBy("label").agg(F.count("*").alias("n"))


@query("j5_change_types", f"{_DIFF} SELECT c.path, change_type, coalesce('t' || len(b.sha256), 'spec') AS file_type FROM c LEFT JOIN {_B} AS b ON b.path = c.path")
def change_types(spark, d):
    a, b = _snapshots(spark, d)
    kinds = b.select("path", _of("t", F.length("sha256").cast("string")).alias("file_type"))
    return incremental.with_types(incremental.compute_changes(b, a), kinds).select("path", "change_type", "file_type")


@query("r10_preview_rows", f"{_DIFF} SELECT path, (SELECT count(*) FROM c) - 10 AS more FROM c ORDER BY path LIMIT 10")
def preview_rows(spark, d):
    a, b = _snapshots(spark, d)
    return incremental.preview(incremental.compute_changes(b, a))


_MODELS = "(VALUES " + ", ".join(f"({i}, '{m[0]}', {m[1]}, {m[2]}, '{m[3]}')" for i, m in enumerate(catalog.MODELS)) + ") AS t(i, model, dimensions, max_tokens, kind)"


@query("p30_models", f"SELECT model, dimensions, max_tokens, kind, count(*) AS texts, count(*) FILTER (length(text) > 4::BIGINT * max_tokens) AS long FROM documents JOIN {_MODELS} ON i = doc_id % {len(catalog.MODELS)} GROUP BY ALL")
def model_table(spark, d):
    """Each model with how many of the texts that are dealt to it are longer than it takes, at four characters a token."""
    models = F.broadcast(catalog.models(spark))
    both = docs(spark, d).join(models, F.col("ordinal") == F.col("doc_id") % len(catalog.MODELS))
    return both.groupBy("model", "dimensions", "max_tokens", "kind").agg(F.count("*").alias("texts"), F.count_if(F.length("text").cast("bigint") > 4 * F.col("max_tokens").cast("bigint")).alias("long"))


# --- tools (Q, D22) ----------------------------------------------------------------------

_CLIENTS = "(VALUES " + ", ".join(f"({i}, '{c[0]}', '{c[1]}', '{c[3]}', {'NULL' if c[6] is None else c[6]}::DOUBLE, {'NULL' if c[7] is None else c[7]}::DOUBLE)" for i, c in enumerate(catalog.CLIENTS)) + ") AS t(i, name, layer, language, stake, node)"


@query("q10_p27_forks", "SELECT name, epoch, current, count(doc_id) AS files FROM (VALUES " + ", ".join(f"({i}, '{n}', {e}, '{n}' = '{catalog.CURRENT_FORK}')" for i, (n, e, _, _) in enumerate(catalog.FORKS)) + f") AS t(i, name, epoch, current) LEFT JOIN documents ON {_FORK}[doc_id % 8 + 1] = name GROUP BY ALL")
def forks(spark, d):
    """The list of forks with how many spec files each has."""
    files = docs(spark, d).select(X.fork_of_path(_path()).alias("name"), "doc_id")
    rows = api.fork_list(spark).select("name", F.col("epoch").cast("int").alias("epoch"), "current")
    return rows.join(files, "name", "left").groupBy("name", "epoch", "current").agg(F.count("doc_id").alias("files"))


@query("q14_p26_clients", f"SELECT doc_id, name, layer, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN node END, 0), stake, n_chars::DOUBLE) AS percentage FROM documents JOIN {_CLIENTS} ON i = doc_id % 10")
def client_list(spark, d):
    """The share shown of clients whose node share is unknown, zero or known, by document."""
    node = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, F.col("node_percentage"))
    both = docs(spark, d).join(F.broadcast(catalog.clients(spark)), F.col("ordinal") == F.col("doc_id") % 10)
    return both.select("doc_id", "name", "layer", X.shown_share(node, F.coalesce("stake_percentage", F.col("n_chars").cast("double"))).alias("percentage"))


@query("q15_client_lookup", f"""
WITH t AS (SELECT DISTINCT substr(lang, 1, 1) AS part FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT substr(md5(text), 1, 1) FROM documents),
r AS (SELECT part, name, language, i, row_number() OVER (PARTITION BY part ORDER BY i) AS n FROM t JOIN {_CLIENTS} ON contains(lower(name), lower(part)))
SELECT part, name, language FROM r WHERE n = 1""")
def client_lookup(spark, d):
    """The first client whose name holds each of the parts that documents give."""
    t = docs(spark, d)
    parts = t.select(F.substring("lang", 1, 1).alias("part")).unionByName(t.select(F.substring(F.md5("text"), 1, 1).alias("part"))).where("part is not null").distinct()
    return api.clients_named(catalog.clients(spark), parts).select("part", "name", "language")


@query("q16_client_diversity", """
WITH s AS (SELECT lang AS name, coalesce(source, '') AS layer, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT name, layer, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY layer) AS percentage FROM s)
SELECT name, layer, round(percentage, 9) AS percentage, round(max(percentage) OVER (PARTITION BY layer), 9) AS largest_share, max(percentage) OVER (PARTITION BY layer) > 66 AS supermajority_risk FROM p""")
def client_diversity(spark, d):
    """Shares of languages in each source, and whether one holds a supermajority of it."""
    n = docs(spark, d).groupBy(F.col("lang").alias("name"), F.coalesce("source", F.lit("")).alias("layer")).agg(F.count("*").alias("n"))
    total = n.groupBy("layer").agg(F.sum("n").alias("all"))
    shares = n.join(total, "layer").withColumn("percentage", F.lit(100.0) * F.col("n") / F.col("all"))
    return api.with_risk(shares).select("name", "layer", F.round("percentage", 9).alias("percentage"), F.round("largest_share", 9).alias("largest_share"), "supermajority_risk")


@query("q17_client_pairs", f"""
WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{p.split(' + ')[0]}', '{p.split(' + ')[1]}')" for p, _ in catalog.PAIRS)}) AS t(pair, el, cl)), u AS (SELECT name, count(*) AS n FROM documents JOIN {_CLIENTS} ON i = doc_id % 10 GROUP BY 1)
SELECT pair, e.n + c.n AS documents FROM p JOIN u e ON e.name = el JOIN u c ON c.name = cl""")
def client_pairs(spark, d):
    """The recommended pairs with how many documents their two clients have."""
    used = docs(spark, d).join(F.broadcast(catalog.clients(spark)), F.col("ordinal") == F.col("doc_id") % 10).groupBy("name").agg(F.count("*").alias("n"))
    members = api.client_pairs(spark).select("pair", F.explode(F.split("pair", r" \+ ")).alias("name"))
    return members.join(used, "name").groupBy("pair").agg(F.sum("n").alias("documents")).where("documents > 0")


_TOPIC = "['slashing','Boost','MEV','maxeb limits','nothing like it','PBS','']"
_KEYS = "(VALUES " + ", ".join(f"({i}, '{g[0]}', '{g[2].lower().replace(chr(39), chr(39) * 2)}')" for i, g in enumerate(catalog.GUIDANCE)) + ") AS t(i, key, summary)"


@query("q13_guidance", f"""
WITH t AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN {_TOPIC}[doc_id // 2 % 7 + 1] ELSE lower(substr(text, 1, 2)) END AS topic FROM documents WHERE text IS NOT NULL),
r AS (SELECT topic, key, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN key = lower(topic) THEN 0 ELSE 1 END, i) AS n FROM t JOIN {_KEYS} ON key = lower(topic) OR contains(key, lower(topic)) OR contains(lower(topic), key) OR contains(summary, lower(topic)))
SELECT topic, key FROM r WHERE n = 1""")
def guidance(spark, d):
    """The guidance of all topics that documents ask for."""
    named = F.get(F.array(*map(F.lit, ("slashing", "Boost", "MEV", "maxeb limits", "nothing like it", "PBS", ""))), (F.floor(F.col("doc_id") / 2) % 7).cast("int"))
    topics = docs(spark, d).where("text is not null").select(F.when(F.col("doc_id") % 2 == 0, named).otherwise(F.lower(F.substring("text", 1, 2))).alias("topic"))
    return api.guidance_of(catalog.guidance(spark), topics).select(F.col("asked").alias("topic"), "key")


@query("q19_guidance_upsert", f"""
WITH n AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN 'Churn' ELSE 'About ' || lang END AS topic FROM documents WHERE lang IS NOT NULL)
SELECT key, false AS fresh FROM {_KEYS} WHERE key NOT IN (SELECT lower(topic) FROM n) UNION ALL SELECT lower(topic), true FROM n""")
def guidance_upsert(spark, d):
    """Guidance with the topics that documents bring: known ones are replaced, others added."""
    base = catalog.guidance(spark)
    topics = docs(spark, d).where("lang is not null").select(F.when(F.col("doc_id") % 4 == 0, "Churn").otherwise(_of("About ", F.col("lang"))).alias("topic")).distinct()
    none = F.array().cast("array<string>")
    made = topics.select(F.lit(0).alias("ordinal"), F.lit("").alias("key"), "topic", F.lit("fresh").alias("summary"), none.alias("key_points"), none.alias("gotchas"), none.alias("references"))
    return api.with_guidance(base, made).select("key", (F.col("summary") == "fresh").alias("fresh"))


# --- files written from documents (S, M, Q over trees) --------------------------------------

_TREE = """
WITH f AS (SELECT doc_id, '# File ' || doc_id || chr(10) || chr(10) || md5(text) || chr(10) AS content, doc_id * 1000 + 1000000000000000007 AS mtime_ns, doc_id % 11 AS k FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, CASE k WHEN 0 THEN 'consensus-specs/specs/deneb/x y/f' || doc_id || '.md' WHEN 1 THEN 'EIPs/EIPS/eip-' || doc_id || '.md' WHEN 2 THEN 'builder-specs/specs/b' || doc_id || '.md' WHEN 3 THEN 'leanSpec/src/lean_spec/p' || (doc_id % 3) || '/m' || doc_id || '.py'
  WHEN 4 THEN 'leanSpec/src/lean_spec/test_' || doc_id || '.py' WHEN 5 THEN 'leanSig/src/r' || doc_id || '.rs' WHEN 6 THEN 'leanSig/target/r' || doc_id || '.rs' WHEN 7 THEN 'pm/n' || doc_id || '.md' WHEN 8 THEN 'leanSnappy/s' || doc_id || '.py' WHEN 9 THEN 'clients/reth/c' || doc_id || '.rs' ELSE 'EIPs/EIPS/deep/eip-' || doc_id || '.md' END AS file FROM f)
"""


def _tree(spark: SparkSession, d: str) -> str:
    """A tree of checkouts with a file for each document; its folder."""
    k, i = F.col("doc_id") % 11, _id()
    names = ("consensus-specs/specs/deneb/x y/f", i, ".md"), ("EIPs/EIPS/eip-", i, ".md"), ("builder-specs/specs/b", i, ".md"), ("leanSpec/src/lean_spec/p", (F.col("doc_id") % 3).cast("string"), "/m", i, ".py"), ("leanSpec/src/lean_spec/test_", i, ".py"), ("leanSig/src/r", i, ".rs"), ("leanSig/target/r", i, ".rs"), ("pm/n", i, ".md"), ("leanSnappy/s", i, ".py"), ("clients/reth/c", i, ".rs"), ("EIPs/EIPS/deep/eip-", i, ".md")
    path = F.get(F.array(*[_of(*n) for n in names]), k.cast("int"))
    root = S.tree_path(shared_folder(spark))
    S.write_tree(docs(spark, d).where("text is not null").select(path.alias("path"), _of("# File ", i, "\n\n", F.md5("text"), "\n").alias("content"), (F.col("doc_id") * 1000 + 1_000_000_000_000_000_007).alias("mtime_ns")), root)
    return root


@query("s1_s10_p21_file_sources", _TREE + """
SELECT source, repo, substr(file, length(top) + 1) AS path, file_type, mtime_ns, sha256(content) AS sha256 FROM t JOIN (VALUES
  ('all', 0, 'consensus-specs', 'consensus-specs/', 'spec'), ('all', 1, 'EIPs', 'EIPs/', 'eip'), ('all', 2, 'builder-specs', 'builder-specs/', 'builder'), ('all', 3, 'leanSpec', 'leanSpec/', 'lean'), ('all', 5, 'leanSig', 'leanSig/', 'rust:leanSig'), ('all', 7, 'pm', 'pm/', 'pm'), ('all', 8, 'leanSnappy', 'leanSnappy/', 'lean'),
  ('rust', 5, 'leanSig', 'leanSig/', 'rust:leanSig'), ('client', 9, 'reth', 'clients/reth/', 'client')) AS m(source, k, repo, top, file_type) USING (k)""")
def file_sources(spark, d):
    """Every source over a tree, with times in nanoseconds and contents by hash."""
    root = _tree(spark, d)
    shown = lambda rows, name: rows.select(F.lit(name).alias("source"), "repo", "path", "file_type", "mtime_ns", S.hash_of(F.col("content")).alias("sha256"))
    client = S.client_files(spark, f"{root}/clients/reth", "reth", "rust").select("path", F.lit("client").alias("file_type"), F.lit("reth").alias("repo"), "content")
    times = S.tree(spark, f"{root}/clients/reth", names="*.rs").select("path", "mtime_ns")
    return shown(cli.gather(spark, root), "all").unionByName(shown(S.rust_source_files(spark, f"{root}/leanSig", "leanSig"), "rust")).unionByName(shown(client.join(times, "path"), "client"))


@query("j7_registry_on_disk", "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}')" for r in catalog.CLIENT_REPOS) + ") AS t(repo)) SELECT repo, repo = 'reth' AND EXISTS (SELECT 1 FROM documents WHERE doc_id % 11 = 9 AND text IS NOT NULL) AS present FROM r")
def registry_on_disk(spark, d):
    return S.on_disk(spark, catalog.client_repos(spark).select("repo"), f"{_tree(spark, d)}/clients").select("repo", "present")


@query("m1_rebuild_reasons", f"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'No manifest exists' WHEN doc_id % 4 = 1 AND lang <> 'en' THEN 'Embedding model changed: ' || lang || ' -> en' WHEN doc_id % 4 = 2 AND doc_id % 3 <> 0 THEN 'Chunk config changed: {{''chunk_size'': ' || (doc_id % 3) || '}} -> {{''chunk_size'': 0}}' END AS reason FROM documents""")
def rebuild_reasons(spark, d):
    """Why manifests with the settings that documents give would be rebuilt; null if they need not."""
    reason = F.udf(lambda i, lang: needs_rebuild(None if i % 4 == 0 else Manifest(embedding_model=(lang or "") if i % 4 == 1 else "", chunk_config={"chunk_size": i % 3} if i % 4 == 2 else {}), "en", {"chunk_size": 0}), "string", useArrow=True)
    return docs(spark, d).select("doc_id", reason("doc_id", "lang").alias("reason"))


@query("m5_dry_run", f"""{_DIFF.replace("'d/' || doc_id", "'pm/d/' || doc_id || '.md'").replace("a.sha256 = b.sha256", "md5(a.sha256) = md5(b.sha256)")},
n AS (SELECT count(*) FILTER (change_type = 'add') AS a, count(*) FILTER (change_type = 'modify') AS m, count(*) FILTER (change_type = 'delete') AS x FROM c)
SELECT path, change_type, 'Would perform incremental update:' || CASE WHEN a > 0 THEN chr(10) || '  Add ' || a || ' files' ELSE '' END || CASE WHEN m > 0 THEN chr(10) || '  Modify ' || m || ' files' ELSE '' END || CASE WHEN x > 0 THEN chr(10) || '  Delete ' || x || ' files' ELSE '' END || chr(10) || '  ~' || 10 * (a + m) || ' chunks to add' || chr(10) || '  ~' || (m + x) || ' chunks to delete' AS summary FROM c, n""")
def dry_run_plan(spark, d):
    """What an update of snapshot A's index to B's files would do; nothing is written."""
    t, index = docs(spark, d), incremental.Index(spark, shared_folder(spark))
    index.index(_note_files(t.where("doc_id % 7 <> 0"), F.col("text"), F.col("doc_id") * 10))
    text = F.when(F.col("doc_id") % 5 == 0, _of(F.col("text"), "!")).otherwise(F.col("text"))
    plan = index.dry_run(_note_files(t.where("doc_id % 11 <> 0"), text, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 10 + 1).otherwise(F.col("doc_id") * 10)))
    return plan.changes.select("path", "change_type").withColumn("summary", F.lit(plan.summary()))


@query("q4_q11_q12_service", f"""
WITH n AS (SELECT count(*) AS chunks FROM documents WHERE doc_id % 7 <> 0)
SELECT * FROM (VALUES ('health', 'true'), ('index_exists', 'true'), ('current_fork', '{catalog.CURRENT_FORK}'), ('missing index', 'false')) AS t(name, value)
UNION ALL SELECT 'commit', '1' FROM n UNION ALL SELECT 'chunks', chunks::VARCHAR FROM n
UNION ALL SELECT 'source of fn_' || doc_id, 'def fn_' || doc_id || '(x):' || chr(10) || '    return x' || chr(10) FROM documents WHERE doc_id < 40 AND doc_id % 8 = 5""")
def service_status(spark, d):
    """The service's own answers over an index and spec files made of documents: health, version, and functions by name."""
    t, folder = docs(spark, d), shared_folder(spark)
    index = incremental.Index(spark, folder)
    index.index(_note_files(t.where("doc_id % 7 <> 0"), F.col("text"), F.col("doc_id") * 10))
    service = api.Service(spark, index, None, _files(spark, d))
    version = service.get_spec_version()
    rows = [("health", str(service.health()["healthy"]).lower()), ("index_exists", str(version["index_exists"]).lower()), ("current_fork", version["current_fork"]), ("missing index", str(api.Service(spark, incremental.Index(spark, f"{folder}/none")).health()["healthy"]).lower()), ("commit", str(index.manifest()[0].commit)), ("chunks", str(index.live().count()))]
    for r in t.where("doc_id < 40 AND doc_id % 8 = 5").select("doc_id").toLocalIterator():
        rows.append((f"source of fn_{r['doc_id']}", service.analyze_function(f"fn_{r['doc_id']}", "electra")[0]["source"]))
    return spark.createDataFrame(rows, "name string, value string")


@query("d22_request_rules", """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS q, CASE WHEN doc_id % 3 = 0 THEN 'Electra' WHEN doc_id % 3 = 1 THEN 'gloas' END AS fork, (doc_id % 60)::INT AS n, upper(lang) || '_' || doc_id AS name FROM documents)
SELECT doc_id, CASE WHEN length(q) NOT BETWEEN 1 AND 1000 THEN 'query' WHEN fork = 'gloas' THEN 'fork' WHEN n NOT BETWEEN 1 AND 50 THEN 'limit' END AS error,
       CASE WHEN length(name) > 100 THEN 'length' WHEN NOT regexp_full_match(name, '[A-Z][A-Z0-9_]*') THEN 'pattern' END AS name_error FROM r""")
def request_rules(spark, d):
    k = F.col("doc_id") % 3
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("q"), F.when(k == 0, "Electra").when(k == 1, "gloas").alias("fork"), (F.col("doc_id") % 60).cast("int").alias("n"), _of(F.upper("lang"), "_", _id()).alias("name"))
    return rows.select("doc_id", validation.search_error(F.col("q"), F.col("fork"), F.col("n")).alias("error"), validation.name_error(F.col("name"), validation.CONSTANT).alias("name_error"))


def _index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records of one chunk a document, typed and forked by id, with hashed vectors."""
    kinds = F.get(F.array(*map(F.lit, ("spec", "eip", "function", "constant", "lean_class", "rust_function"))), (F.col("doc_id") % 6).cast("int"))
    meta = F.create_map(F.lit("eip"), _id())
    chunks = docs(spark, d).select(_of("c", _id()).alias("chunk_id"), F.col("text").alias("content"), _path().alias("source"), _fork().alias("fork"), F.col("lang").alias("section"), kinds.alias("chunk_type"), meta.alias("metadata"), F.lit("leanSig").alias("repo"))
    return K.to_records(chunks, VX.encode(F.col("content")))


_KIND = "['spec','eip','function','constant','lean_class','rust_function']"


def _tool_sql(asked: str, final: str) -> str:
    """The records r of ``_index_rows`` with their scores for a query, s (as compared) and score (as shown), then ``final``."""
    slot = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {VX.DIMENSIONS} AS pos, count(*)::DOUBLE AS n"
    url, branch = next((u, b) for r, u, b in catalog.REPOS if r == "leanSig")
    return f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
n AS (SELECT doc_id, {slot} FROM t GROUP BY ALL),
v AS (SELECT doc_id, pos, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS w FROM n),
qt AS (SELECT unnest(regexp_extract_all(lower('{asked}'), '[a-z0-9_]+')) AS t),
qn AS (SELECT {slot} FROM qt GROUP BY ALL),
q AS (SELECT pos, (n / (SELECT sqrt(sum(n * n)) FROM qn))::FLOAT::DOUBLE AS w FROM qn),
c AS (SELECT doc_id, sum(v.w * coalesce(q.w, 0)) / (sqrt(sum(v.w * v.w)) * (SELECT sqrt(sum(w * w)) FROM q)) AS score FROM v LEFT JOIN q USING (pos) GROUP BY doc_id),
r AS (SELECT 'c' || doc_id AS chunk_id, {_PATH} AS source, {_FORK}[doc_id % 8 + 1] AS fork, lang AS section, {_KIND}[doc_id % 6 + 1] AS chunk_type,
             round(coalesce(score, 0), 12) AS s, round(coalesce(score, 0), 6) AS score, '{url}/blob/{branch}/' || {_PATH} AS github_url FROM documents LEFT JOIN c USING (doc_id)),
{final}"""


def _best(where: str, limit: int) -> str:
    return f"SELECT * FROM r WHERE {where} ORDER BY s DESC, chunk_id LIMIT {limit}"


_SHOWN = "chunk_id, source, section, chunk_type, score, github_url"


def _one_leg(asked: str, where: str, limit: int) -> str:
    return _tool_sql(asked, f"h AS ({_best(where, limit)}) SELECT {_SHOWN} FROM h")


def _tool(name: str, run: Callable[[search.Searcher], DataFrame], sql: str) -> None:
    @query(name, sql)
    def tool(spark, d):
        return run(search.Searcher(_index_rows(spark, d), catalog.repos(spark))).select("chunk_id", "source", "section", "chunk_type", F.round("score", 6).alias("score"), "github_url")


_tool("q1_combined_search", lambda s: s.combined(_ASKED, "electra", 10, True), _tool_sql(_ASKED, f"""
l AS (SELECT *, 0 AS leg FROM ({_best("fork = 'electra'", 10)}) UNION ALL SELECT *, 1 FROM ({_best("chunk_type = 'eip'", 10)}) UNION ALL SELECT *, 2 FROM ({_best("chunk_type = 'lean_class'", 10)})),
k AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY s DESC, chunk_id) AS rank FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY leg, rank) AS first FROM k)
SELECT {_SHOWN} FROM f WHERE first = 1 ORDER BY s DESC, leg, rank LIMIT 10"""))
_tool("q2_search_specs", lambda s: s.search_specs(_ASKED, None, 10), _tool_sql(_ASKED, f"h AS ({_best('true', 20)}) SELECT {_SHOWN} FROM h WHERE chunk_type <> 'eip' ORDER BY s DESC, chunk_id LIMIT 10"))
_tool("q5_search_eip", lambda s: s.search_eip(_ASKED, None, 10), _one_leg(_ASKED, "chunk_type = 'eip'", 10))
_tool("q6_search_lean", lambda s: s.search_lean(_ASKED, 10), _one_leg(_ASKED, "chunk_type LIKE 'lean%'", 10))
_tool("q7_search_pq", lambda s: s.search_pq(_ASKED, 10, "leanSig"), _one_leg(_ASKED, "chunk_type LIKE 'rust%'", 10))
_tool("q8_search", lambda s: s.search(_ASKED, 10, "deneb"), _one_leg(_ASKED, "fork = 'deneb'", 10))
_tool("q9_search_function", lambda s: s.search_function("fn", "bellatrix"), _one_leg("def fn", "fork = 'bellatrix' AND chunk_type = 'function'", 5))
_tool("q9_search_constant", lambda s: s.search_constant("MAX_of_the"), _one_leg("MAX_of_the constant value", "chunk_type = 'constant'", 10))


@query("p28_encode", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents),
n AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {VX.DIMENSIONS} AS pos, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
v AS (SELECT doc_id, pos, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS w FROM n)
SELECT doc_id, pos::INT AS at, round(w, 6) AS weight FROM v""")
def encoded(spark, d):
    vector = docs(spark, d).select("doc_id", VX.encode(F.col("text")).alias("v"))
    return vector.select("doc_id", F.posexplode("v").alias("at", "w")).where("w <> 0").select("doc_id", "at", F.round(F.col("w").cast("double"), 6).alias("weight"))


@query("k4_coarse_cells", f"SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 20")
def coarse_cells(spark, d):
    """Search through the coarse index with every cell probed, where it must equal the exact search."""
    e = table(spark, d, "embeddings")
    centres = cells.fit(e, "embedding", "vec_id")
    found = cells.search(cells.assign(e, centres, "embedding"), centres, _first_vector(e), 20, len(centres), "embedding", "vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("q3_q18_content_lookup", """
WITH n AS (SELECT DISTINCT 'x' || substr(md5(text), 1, 2) AS name FROM documents WHERE doc_id % 5 = 0 UNION SELECT DISTINCT lower(substr(text, 40, 7)) FROM documents WHERE doc_id % 5 = 0 AND length(text) >= 46)
SELECT name, 'c' || doc_id AS chunk_id FROM documents JOIN n ON contains(lower(text), lower(name)) WHERE doc_id % 11 <> 0""")
def content_lookup(spark, d):
    """Live contents that hold a name, for some hundreds of names: by gram postings of two commits, not by reading contents."""
    t, table_ = docs(spark, d), ChunkTable(spark, shared_folder(spark))
    table_.replace(_stored(t.where("doc_id % 7 <> 0").withColumn("t", F.col("text"))), 1)
    table_.append(_stored(t.where("doc_id % 7 = 0").withColumn("t", F.col("text"))), 2)
    table_.delete(t.where("doc_id % 11 = 0").select(_of("c", _id()).alias("chunk_id")), 3)
    index = grams.GramIndex(spark, table_)
    index.refresh(3)
    some = t.where("doc_id % 5 = 0")
    names = some.select(_of("x", F.substring(F.md5("text"), 1, 2)).alias("n")).unionByName(some.where(F.length("text") >= 46).select(F.lower(F.substring("text", 40, 7)).alias("n"))).distinct()
    return index.find([r["n"] for r in names.toLocalIterator()], 3, live=True).select("name", "chunk_id")


@query("k4_quantised_exact", f"SELECT vec_id, round({_SCORE}, 6) AS score FROM embeddings ORDER BY {_SCORE} DESC, vec_id LIMIT 20")
def quantised_exact(spark, d):
    """The exact search of the product-quantised index: codes bound the scores, candidates are re-ranked."""
    e = table(spark, d, "embeddings")
    index, books = _quantised(spark, e)
    found = quantised.search(index, e, books, _first_vector(e), 20, exact=True, vector="embedding", key="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _quantised(spark: SparkSession, e: DataFrame) -> tuple[DataFrame, quantised.Books]:
    """The index of all embeddings, written by cell."""
    books, path = quantised.fit(e, "embedding", "vec_id", parts=16), f"{shared_folder(spark)}/codes"
    quantised.write(quantised.encode(e, books, "embedding", "vec_id"), path)
    return spark.read.parquet(path), books


@query("k4_quantised_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 500 = 0")
def quantised_recall(spark, d):
    """Whether the index finds at least nine of ten true neighbours at its default settings (a bounded number of candidates by code)."""
    e = table(spark, d, "embeddings")
    index, books = _quantised(spark, e)
    asked = [r["embedding"] for r in e.where("vec_id % 500 = 0").select("embedding").toLocalIterator()]
    share = quantised.recall(index, e, books, asked, 10, "embedding", "vec_id")
    return spark.createDataFrame([(len(asked), share >= 0.9)], "queries bigint, enough boolean")


@query("t1_page_headings", r"""
SELECT page_id, i::INT AS at, lower(regexp_extract(h, '<h([1-3])', 1))::INT AS level, regexp_replace(regexp_extract(h, '(?s)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '<[^>]*>', '', 'g') AS heading
FROM (SELECT page_id, a[i + 1] AS h, i FROM (SELECT page_id, a, unnest(range(len(a))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-3][^>]*>.*?</h[1-3]>') AS a FROM pages)))""")
def page_headings(spark, d):
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<h[1-3][^>]*>.*?</h[1-3]>"), F.lit(0))).alias("at", "h"))
    return found.select("page_id", "at", F.regexp_extract("h", "<h([1-3])", 1).cast("int").alias("level"), F.regexp_replace(F.regexp_extract("h", r"(?s)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), "<[^>]*>", "").alias("heading"))


__all__ = ["ORACLES", "QUERIES", "python_rows"]

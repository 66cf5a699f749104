import threading
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselar.functions import vectors
from tesselar.functions.lineage import BATCH_BYTES, BATCH_ROWS
from tesselar.operators import chunking
from tesselar.plans import grams, search
from tesselar.plans.incremental import Index
from tesselar.streaming import ingest

FILES = "path string, repo string, content string"
STEPS = {
    "encode": lambda spark: vectors.encode(F.col("x")),
    "cosine_to": lambda spark: vectors.cosine_to(F.col("x"), [1.0, 0.0]),
    "notes": lambda spark: chunking.notes_chunks(spark.createDataFrame([], FILES)),
    "python": lambda spark: chunking.python_chunks(spark.createDataFrame([], FILES)),
    "extract": lambda spark: chunking.extract(spark.createDataFrame([], FILES), "rust_tree"),
    "stream": lambda spark: ingest.newest(spark.createDataFrame([], ingest.EVENT)),
    "postings": lambda spark: grams.postings(spark.createDataFrame([], "chunk_id string, content string")),
}


@pytest.mark.parametrize("step", STEPS)
def test_batches_of_a_step_are_bounded(spark, step):
    """A task's Python holds a batch of bounded rows and bytes, whatever the size of its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    STEPS[step](spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES


def unbounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))


def in_a_thread(step):
    """What a step returns that runs in a thread of its own, as a service's requests do; such a thread has no active session."""
    found = []
    thread = threading.Thread(target=lambda: found.append(step()))
    thread.start()
    thread.join()
    return found[0]


def batches(rows, text):
    """(rows, bytes) of the batches that Python is given."""

    @F.arrow_udf("struct<n: int, size: bigint>")
    def seen(x: pa.Array) -> pa.Array:
        return pa.array([{"n": len(x), "size": x.nbytes}] * len(x))

    return {(r.b.n, r.b.size) for r in rows.select(seen(text).alias("b")).distinct().collect()}


def test_batches_of_a_search_in_a_thread_are_bounded(spark):
    unbounded(spark)
    rows = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("x"), 40000).alias("content"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    assert in_a_thread(lambda: search.search(rows, [1.0, 0.0], 2).collect())[0].chunk_id == "0"
    for n, size in batches(rows, F.col("content")):
        assert n <= BATCH_ROWS and size <= 2 * BATCH_BYTES


def test_batches_of_the_tools_in_a_thread_are_bounded(spark):
    rows = spark.range(3000).coalesce(1).select(*[F.lit("x").alias(c) for c in search.HIT if c not in ("score", "chunk_id", "chunk_type")], F.lit("lean_class").alias("chunk_type"), F.col("id").cast("string").alias("chunk_id"), F.array(*[F.lit(1.0)] * 384).alias("vector"))
    for tool in ("search_lean", "search_specs"):
        unbounded(spark)
        assert [r.chunk_id for r in in_a_thread(lambda tool=tool: getattr(search.Searcher(rows), tool)("a b", limit=2).collect())] == ["0", "1"]
        assert max(n for n, _ in batches(rows, F.col("content"))) <= BATCH_ROWS


def test_batches_that_an_index_encodes_in_a_thread_are_bounded(spark, tmp_path):
    unbounded(spark)
    chunks = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("chunk_id"), F.lit("a b").alias("content"), *[F.lit("x").alias(c) for c in ("source", "repo", "fork", "section", "chunk_type")], F.create_map(F.lit("h1"), F.lit("x")).alias("metadata"))
    assert in_a_thread(lambda: Index(spark, f"{tmp_path}/i")._records(chunks).where("size(vector) = 384").count()) == 3000
    assert max(n for n, _ in batches(chunks, F.col("content"))) <= BATCH_ROWS


LONG = [None, "", "\u0130K \u03a3_a\u212a", "ab cd " * 700_000, "a" * 200_000 + " b", "\u00e9" * 70_000 + "zz", "q" * ((1 << 16) - 1) + "\u0130w", " ".join(f"w{i}" for i in range(70_000))]


def test_memory_of_the_embedder_does_not_grow_with_a_text():
    """The tokens of a text are held in runs: a few times the text itself, not 26 times."""
    tracemalloc.start()
    try:
        vectors.hash_embed(LONG[3:4])
        assert tracemalloc.get_traced_memory()[1] < 4 * len(LONG[3])
    finally:
        tracemalloc.stop()


def test_vectors_of_long_texts_count_all_tokens():
    want = np.zeros((len(LONG), vectors.DIMENSIONS))
    for row, text in zip(want, LONG, strict=True):
        for t in vectors.tokens(text or ""):
            row[vectors.slot(t)] += 1
    norm = np.sqrt((want * want).sum(axis=1, keepdims=True))
    assert (vectors.hash_embed(LONG) == np.divide(want, norm, out=want, where=norm > 0).astype(np.float32)).all()

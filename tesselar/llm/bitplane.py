"""Operator 5: token ids in bit-plane shuffled blocks.

Documents are put in order of doc_id, their ids (end id included) make one stream
for each range of ids, and the stream is cut into blocks of BLOCK ids. A block is
transposed into its four byte planes, each plane compressed with zstandard; the
rows of the written table are the blocks with their index: part, block number,
first id, count, and which documents begin where. Parquet holds the blocks, so
files commit as a whole and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, pieces_of, prefix_sums, small_batches, table
from .tokens import packed, vocabulary

BLOCK = 65536
PART_BYTES = 8 << 20
LEVEL = 1
MAGIC = b"TBP1"
PLANES = 4
HEADER = struct.Struct("<4sI4I")
STORED = "part int, block int, first bigint, n_ids int, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"


def encode_block(ids: np.ndarray, level: int = LEVEL) -> bytes:
    """One block of unsigned 32-bit ids: header, then its byte planes, each a zstandard frame."""
    import zstandard

    write = zstandard.ZstdCompressor(level=level).compress
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
    frames = [write(p.tobytes()) for p in planes]
    return HEADER.pack(MAGIC, len(ids), *map(len, frames)) + b"".join(frames)


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if it is none."""
    import zstandard

    magic, n, *sizes = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    read, at, planes = zstandard.ZstdDecompressor(), HEADER.size, np.empty((PLANES, n), np.uint8)
    for p, size in enumerate(sizes):
        planes[p] = np.frombuffer(read.decompress(data[at : at + size], max_output_size=max(n, 1)), np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def write_ids(docs: DataFrame, out: str, path: str, block: int = BLOCK, level: int = LEVEL) -> None:
    """Writes the ids of documents (doc_id, text) to ``out`` in ascending doc_id order.

    A null text counts as empty, a null doc_id comes first, rows of equal id stand
    side by side, in order of their texts' hashes, and may be in several parts. Texts of
    any length are written whole, over as many blocks as they fill; other columns are
    ignored. An empty table gives an empty folder of blocks.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(24, pieces_of(size, PART_BYTES))
    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("payload", pa.binary())])

    def stream(batches):
        part, number, first, end = None, 0, 0, 0
        held, held_n, ids, starts = [], 0, [], []

        def flush(n):
            nonlocal held, held_n, number, first
            data = b"".join(held)
            out, held = np.frombuffer(data[: 4 * n], "<u4"), [data[4 * n :]]
            held_n -= n
            cut = sum(s < first + n for s in starts) if starts and starts[-1] >= first + n else len(starts)
            row = [[part], [number], [first], [n], [ids[:cut]], [starts[:cut]], [encode_block(out, level)]]
            del ids[:cut], starts[:cut]
            number, first = number + 1, first + n
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(row, kinds, strict=True)], schema=kinds)

        for rows, coded in packed(batches, path):
            part = rows.column(2)[0].as_py()
            for doc_id, data in zip(rows.column(0).to_pylist(), coded, strict=True):
                ids.append(doc_id)
                starts.append(end)
                held.append(data)
                held_n += len(data) // 4
                end += len(data) // 4
                while held_n >= block:
                    yield flush(block)
        if held_n:
            yield flush(held_n)

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())  # rows of one id, or all equal, can be split
    by = ["doc_id", "hash", "row"]
    ordered = ordered.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(stream, STORED).write.mode("overwrite").option("compression", "uncompressed").parquet(out)


def read_ids(spark: SparkSession, out: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as packed bytes) of every document that ``write_ids`` wrote."""
    stored = spark.read.schema(STORED).parquet(out)
    starts = prefix_sums(stored.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n", "before").select("part", "before")
    kinds = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def decode(part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        at = [s for x in part["doc_starts"].to_pylist() for s in x] + [sum(part["n_ids"].to_pylist())]
        docs = [d for x in part["doc_ids"].to_pylist() for d in x]
        sums, each, i = [0] * len(docs), [b""] * len(docs), 0
        for first, payload in zip(part["first"].to_pylist(), part["payload"], strict=True):  # a block at a time
            data = decode_block(payload.as_py()).tobytes()
            end = first + len(data) // 4
            while i < len(docs):
                cut = data[4 * max(at[i] - first, 0) : 4 * (at[i + 1] - first)]
                sums[i] = zlib.crc32(cut, sums[i])
                if keep_ids:
                    each[i] += cut
                if at[i + 1] > end:
                    break
                i += 1
        number = part["part"][0].as_py()
        rows = [docs, [number] * len(docs), at[:-1], [b - a for a, b in zip(at, at[1:], strict=False)], sums, each if keep_ids else [None] * len(docs)]
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(rows, kinds, strict=True)], schema=kinds)

    found = stored.groupBy("part").applyInArrow(decode, "doc_id bigint, part int, inner bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return found.join(starts, "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of every row of one doc_id, from the blocks that hold them alone: the index says which."""
    stored = spark.read.schema(STORED).parquet(out)
    began = stored.select("part", "block", F.explode(F.arrays_zip("doc_ids", "doc_starts")).alias("d")).select("part", "block", "d.*")
    near = F.lead("doc_starts").over(Window.partitionBy("part").orderBy("doc_starts"))
    # a part's index is small: a number for each of its documents
    parts = [r[0] for r in stored.where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint"))).select("part").distinct().collect()]
    spans = began.where(F.col("part").isin(parts)).withColumn("end", near).where(F.col("doc_ids") == doc_id).orderBy("part", "doc_starts").collect()
    found = []
    for r in spans:
        end = F.lit(r["end"]).cast("bigint")
        held = stored.where((F.col("part") == r["part"]) & (F.col("first") + F.col("n_ids") > r["doc_starts"]) & F.coalesce(F.col("first") < end, F.lit(True)))
        held = held.select("first", "payload").orderBy("first").collect()  # the blocks of one document
        ids, first = np.concatenate([decode_block(bytes(b["payload"])) for b in held]), held[0]["first"]
        found.append(ids[r["doc_starts"] - first : None if r["end"] is None else r["end"] - first])
    return found


def op5_token_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Workspace(spark, "bitplane").path("ids")
    write_ids(table(spark, sf_dir, "documents"), out, vocabulary())
    return read_ids(spark, out)

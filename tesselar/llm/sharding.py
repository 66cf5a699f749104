"""Operator 6: sharding by a two-pass external shuffle.

Pass one scatters rows by a seeded hash over buckets that each fit in memory, the
copies of a row that has very many by their numbers too;
pass two shuffles every bucket by Fisher-Yates with a seed of its own. Buckets
end to end are the shuffled table, and shard s is the s-th of its equal runs, so
shards differ by one row at most (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, pieces_of, prefix_sums, small_batches, table

SHARDS = 24
BUCKET_BYTES = 16 << 20
SEED = 42
#: Copies of a row from which they are numbered, so that they meet different buckets, and copies that one task numbers.
COPIES, STRETCH = 4096, 10_000


def fisher_yates(n: int, seed: tuple[int, int]) -> np.ndarray:
    """A uniform order of n rows: from the last place down, swap each with a seeded place at or before it."""
    draw = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    picks = draw.integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), np.asarray(picks).tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def numbered(rows: DataFrame, copies: int = COPIES, stretch: int = STRETCH) -> DataFrame:
    """Adds ``copy``: 0 for most rows, 0 to n - 1 for the n copies of a row that has more than ``copies``.

    Copies are alike, so they are counted where they are read and made again from the
    count, a stretch at a time: no task meets them all, and reruns number them alike.
    """
    key = ["doc_id", "crc", "size"]
    many = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > copies).select(*[F.col(c).alias(f"_{c}") for c in key])
    if not many.limit(1).count():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("crc") == F.col("_crc")) & (F.col("size") == F.col("_size"))
    counted = rows.join(many, same, "left_semi").groupBy("doc_id", "text", "size", "crc").agg(F.count("*").alias("_n"))
    parts = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(stretch).cast("bigint")))).repartition("doc_id", "_from")
    made = parts.withColumn("copy", F.explode(F.sequence("_from", F.least(F.col("_from") + stretch, F.col("_n")) - 1))).select(*rows.columns, "copy")
    return rows.join(many, same, "left_anti").withColumn("copy", F.lit(0).cast("bigint")).unionByName(made)


def shuffle_shards(docs: DataFrame, out: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes every row of documents (doc_id, text) to ``out``/shard=s, in slot order within a file, and returns the written table.

    Columns: doc_id, text, size (UTF-8 bytes of the text, null: none, plus 8),
    slot, shard. Null ids and texts, equal texts and repeated rows are rows like
    any other, and texts of any length stay whole; other columns are ignored. An
    empty table gives no rows. Reruns give the same shards and slots.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    n, buckets = total["n"], max(64, pieces_of(total["size"] or 0, bucket_bytes))
    rows = numbered(rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    draw = F.when(F.col("copy") == 0, F.xxhash64(F.lit(seed), "doc_id", "crc")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "crc", "copy"))
    rows = rows.withColumn("bucket", F.pmod(draw, F.lit(buckets)).cast("int")).drop("crc", "copy")
    before = prefix_sums(rows.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n", "before").select("bucket", "before")

    def shuffle(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        order = fisher_yates(bucket.num_rows, (seed, bucket["bucket"][0].as_py()))
        return bucket.take(pa.array(order)).append_column("place", pa.array(np.arange(bucket.num_rows)))

    small_batches(docs.sparkSession)
    mixed = rows.groupBy("bucket").applyInArrow(shuffle, "doc_id bigint, text string, size bigint, bucket int, place bigint")
    at = F.col("before") + F.col("place")
    placed = mixed.join(F.broadcast(before) if buckets <= 65536 else before, "bucket").withColumn("at", at)
    placed = placed.withColumn("shard", F.expr(f"cast(at * {shards} div {max(n, 1)} as int)")).withColumn("slot", F.col("at") - F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}"))
    placed.select("doc_id", "text", "size", "slot", "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(out)
    return docs.sparkSession.read.schema("doc_id bigint, text string, size bigint, slot bigint, shard int").parquet(out)


def op6_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle_shards(table(spark, sf_dir, "documents"), Workspace(spark, "shards").path("records"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return written.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

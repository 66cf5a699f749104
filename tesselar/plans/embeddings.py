"""Vectors kept by model and content, so that no content is encoded twice.

``vectors/commit=N`` holds (hash, vector) of contents that were new at some fill;
fills only append and a hash is never written twice by one writer. Contents that
are missing are found by an anti-join of hashes before anything is encoded, and
encoded in order of their length, so that the texts of a batch are alike.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import encode
from .store import Commits

_VECTOR = T.StructType([T.StructField("hash", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])


def content_hash(content: Column) -> Column:
    """SHA-256 of the content's UTF-8; a null content counts as empty."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


class EmbeddingCache(Commits):
    def __init__(self, spark: SparkSession, root: str, model: str):
        super().__init__(spark, f"{root}/{hashlib.sha256(model.encode()).hexdigest()[:16]}")
        self.model = model

    def known(self) -> DataFrame:
        return self.read("vectors", _VECTOR, self.numbers("vectors")).select("hash", "vector")

    def missing(self, contents: DataFrame) -> DataFrame:
        """(hash, content) of the contents without a vector, each once."""
        asked = contents.select(content_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
        return asked.join(self.known().select("hash"), "hash", "left_anti")

    def fill(self, contents: DataFrame) -> int:
        """Encodes what is missing of the contents (content); the number of contents encoded."""
        number = self.last() + 1
        rows = self.missing(contents).sortWithinPartitions(F.length("content"))
        self.write(rows.select("hash", encode(F.col("content"), self.model).alias("vector")), "vectors", number)
        return self.count("vectors", number)

    def attach(self, rows: DataFrame, column: str = "vector") -> DataFrame:
        """Adds the vectors of rows (content, ...); null where the cache has none."""
        keyed = rows.withColumn("_hash", content_hash(F.col("content")))
        known = self.known().select(F.col("hash").alias("_hash"), F.col("vector").alias(column))
        return keyed.join(known, "_hash", "left").drop("_hash")

    def compact(self) -> None:
        """One table of all vectors in place of many; the old ones go once it is whole."""
        old = self.numbers("vectors", False)
        if len(old) > 1:
            self.write(self.known().dropDuplicates(["hash"]), "vectors", self.last() + 1)
            self.drop("vectors", old)

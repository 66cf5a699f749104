"""Vector expressions and the offline embedder.

The embedder hashes tokens: a token adds one to the component that the first 32
bits of its md5 name, and the vector is scaled to unit length. It needs no model
and any SQL engine can repeat it. Other models register under a name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import small_batches

DIMENSIONS = 384
TOKEN = re.compile(r"[a-z0-9_]+")
BETWEEN = re.compile(r"[^a-z0-9_]")
#: Code points of a text whose tokens are held at a time, and tokens whose slots are.
RUN, SLOTS = 1 << 16, 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where either vector is zero, null where either is null or their sizes differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale))


def cosine_to(a: Column, query: list[float]) -> Column:
    """``cosine`` with one query: whole Arrow batches at a time, the query's own norm taken once."""
    q = np.asarray(query, float)
    size = math.sqrt(float((q * q).sum()))
    small_batches()

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        out, lengths = np.zeros(len(vectors)), vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        fit = lengths == len(q)
        if fit.any() and len(q):
            own = vectors.filter(pa.array(fit))
            m = own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            scale = np.sqrt((m * m).sum(axis=1)) * size
            # sums by row, so that equal vectors have equal scores wherever they stand
            out[fit] = np.divide((m * q).sum(axis=1), scale, out=np.zeros(len(m)), where=scale != 0)
        # a null component is NaN by now; such scores are null, so that they rank last
        return pa.array(out, mask=~fit | np.isnan(out))

    return score(a.cast("array<double>"))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def token_runs(text: str) -> Iterator[list[str]]:
    """The tokens of a text in runs of some RUN code points; a run ends where a token does."""
    text, start = text.lower(), 0
    while start < len(text):
        after = BETWEEN.search(text, start + RUN)
        end = after.start() if after else len(text)
        yield TOKEN.findall(text, start, end)
        start = end


def slot(token: str, dimensions: int = DIMENSIONS) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions


def hash_embed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of texts; texts without tokens (null ones too) give zeros. Memory beside the texts does not grow with them."""
    out, known = np.zeros((len(texts), dimensions)), {}
    for counts, text in zip(out, texts, strict=True):
        for run in token_runs(text or ""):
            fresh = set(run).difference(known)
            if len(known) + len(fresh) > SLOTS:
                known, fresh = {}, set(run)
            known.update((t, slot(t, dimensions)) for t in fresh)
            counts += np.bincount(np.fromiter(map(known.__getitem__, run), np.int64, len(run)), minlength=dimensions)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


Encoder = Callable[[list[str]], np.ndarray]

#: Makers of embedders by model name: called once in each process that encodes, they give a function from a list of texts to a matrix.
EMBEDDERS: dict[str, Callable[[], Encoder]] = {"hashing": lambda: hash_embed}
_READY: dict[str, Encoder] = {}
#: Texts that an embedder is given at once.
TEXTS = 256


def register(name: str, encode: Encoder) -> None:
    EMBEDDERS[name] = lambda: encode


def register_maker(name: str, make: Callable[[], Encoder]) -> None:
    """A model that is costly to set up: ``make`` runs once in each worker, not once a batch."""
    EMBEDDERS[name] = make


def _maker(name: str) -> Callable[[], Encoder]:
    if name not in EMBEDDERS:
        raise LookupError(f"no embedder named {name!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]


def embedder(name: str) -> Encoder:
    return _maker(name)()


def encode(text: Column, model: str = "hashing", size: int = TEXTS) -> Column:
    """Vectors of a text column in Arrow batches of ``size`` texts; a worker sets its model up once."""
    make = _maker(model)
    small_batches()

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = _READY.setdefault(model, make()) if model not in _READY else _READY[model]
        for texts in batches:
            parts = [np.asarray(run(texts.slice(i, size).to_pylist()), np.float32) for i in range(0, len(texts), size)]
            found = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            ends = np.arange(len(texts) + 1, dtype=np.int32) * found.shape[1]
            yield pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))

    return embed(text)


def encode_query(text: str, model: str = "hashing") -> list[float]:
    return [float(x) for x in embedder(model)([text])[0]]


def sparse_terms(docs: DataFrame, id_col: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """The hashing embedding as (id, at, weight) rows, natively."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    at = F.conv(F.substring(F.md5(F.col("t")), 1, 8), 16, 10).cast("bigint") % dimensions
    counted = docs.select(F.col(id_col), F.explode(found).alias("t")).select(id_col, at.alias("at")).groupBy(id_col, "at").agg(F.count("*").cast("double").alias("n"))
    return counted


def norm(values: list[float]) -> float:
    return math.sqrt(sum(v * v for v in values))

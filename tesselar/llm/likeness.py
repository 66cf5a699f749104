"""Near duplicates of the pipeline: texts whose sets of five-word shingles have a Jaccard likeness of 0.8 or more.

Candidates come from the trie self-join of SimHash fingerprints (``simhash.link``), here
of the distinct five-word shingles, and, for the many pairs of likeness 0.8 that differ
in more bits than a trie can take, from MinHash: BANDS bands of ROWS minima each; two
texts meet in a cell if a band agrees. At likeness 0.8 no band agrees with chance
(1 - 0.8**4)**32 = 5e-8. A task has whole cells, compares their texts' minima and
hands on a spanning forest of what may be alike; its components are families. Then
a task has a whole family with its shingle sets, compares them exactly and hands on
a spanning forest of the links. So no step makes a row for each pair, however large
a cell or a family is; those beyond a task's size are cut into chunks that meet two
by two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import Workspace, blocks, components, give_back, gram_hashes, mix, sent, small_batches, text_bytes, whole_groups, word_hashes, word_spans
from .simhash import link, union
from .tokens import spread

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 32, 4
#: Agreeing minima of BANDS * ROWS = 128 from which texts are of one family: 7 standard deviations below the mean of likeness 0.8.
AGREE = 70
#: Texts of a chunk of a cell, and shingles of a chunk of a family.
CELL_ROWS, FAMILY_SHINGLES = 4096, 1 << 19
#: Texts of a group that are compared all at once.
SMALL = 24
_DRAWS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, sorted and distinct, end to end, and the n + 1 offsets.

    ASCII letters count in lower case. A text of fewer words than a shingle has one, all its words; a blank text has none.
    """
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    starts, stops, at = word_spans(raw, ends)
    hashed = word_hashes(raw, starts, stops)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, k)[owner]
    grams = np.zeros(len(owner), np.uint64)
    for s in range(1, k + 1):
        own = size == s
        if own.any():
            grams[own] = mix(gram_hashes(hashed, s)[first[own]] + np.uint64(s))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def keys_of(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set as signed integer, 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64)


def minima(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets x BANDS) signed integers: the minima of ROWS hash functions, 16 bits of each. Sets must not be empty."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint16)
    for i, (flip, odd) in enumerate(_DRAWS.T):
        out[:, i] = (np.minimum.reduceat((grams ^ flip) * odd, at[:-1]) >> np.uint64(20)).astype(np.uint16)
    return out.view(np.int64)


def prints(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set as signed integer: a bit is set if it is in over half of the shingles' hashes; 0 for the empty set."""
    out, full = np.zeros(len(at) - 1, np.uint64), np.flatnonzero(np.diff(at))
    if len(full):
        bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > np.diff(at)[full][:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out.view(np.int64)


def with_key(docs: DataFrame, bands: bool) -> DataFrame:
    """docs (text, other columns stay) with ``key`` of the text's shingle set and, if asked for instead of the text, its ``size``, ``fp`` (SimHash), ``bands`` (none if it has no words) and ``sig``: a byte of each minimum."""
    small_batches(docs.sparkSession)

    def add(batches):
        for block in blocks(batches):
            grams, at = shingle_sets(*text_bytes(block.column(block.schema.get_field_index("text"))))
            made = block.append_column("key", pa.array(keys_of(grams, at)))
            if bands:
                full = np.flatnonzero(np.diff(at))
                found = minima(grams, np.append(at[:-1][full], at[-1])) if len(full) else np.empty((0, BANDS), np.int64)
                has = np.concatenate([[0], np.cumsum(np.diff(at) > 0)])
                sig = np.ascontiguousarray(found.view(np.uint16).astype(np.uint8))
                made = made.append_column("size", pa.array(np.diff(at))).append_column("fp", pa.array(prints(grams, at))).append_column("bands", pa.ListArray.from_arrays(pa.array((has * BANDS).astype(np.int32)), pa.array(found.reshape(-1))))
                made = made.append_column("sig", pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer((has * BANDS * ROWS).astype(np.int32)), pa.py_buffer(sig)]))
                made = made.drop_columns(["text"])
            yield made
        give_back()

    fields = [f for f in docs.schema.fields if not bands or f.name != "text"]
    kind = StructType(fields).add("key", LongType())
    return docs.mapInArrow(add, kind.add("size", LongType()).add("fp", LongType()).add("bands", ArrayType(LongType())).add("sig", BinaryType()) if bands else kind)


LINKS = "a bigint, b bigint"


def _forest(keys: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    """Links (key, key), fewer than there are keys, that join what places a and b of keys join."""
    values, node = np.unique(keys, return_inverse=True)
    parent = np.arange(len(values))
    if a:
        union(parent, node[np.concatenate(a)], node[np.concatenate(b)])
    own = np.flatnonzero(parent != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[own]), pa.array(values[parent[own]])], names=["a", "b"])


def _walk(n: int, alike) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of 0 .. n - 1; alike(x, left) tells which of the places ``left`` are linked to x.

    A text that is joined leaves the rest, so a large group of like texts costs little more than its size.
    """
    left, a, b = np.arange(n), [], []
    while len(left):
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            x = stack.pop()
            ok = alike(x, left)
            new = left[ok]
            if len(new):
                a.append(np.full(len(new), x))
                b.append(new)
                stack += new.tolist()
                left = left[~ok]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def trie_links(ws: Workspace, least: DataFrame) -> DataFrame:
    """Links (a, b) of keys whose fingerprints the trie self-join puts into one component: one for each key but the smallest."""
    printed = least.where("size > 0").select("key", "fp")
    rooted = ws.put(link(ws, printed.select("fp").distinct()), "fp-roots")
    named = ws.put(printed.join(rooted, "fp").select("key", "root"), "fp-keys")
    low = ws.put(named.groupBy("root").agg(F.min("key").alias("b")), "fp-least")
    return named.join(low, "root").where("key <> b").select(F.col("key").alias("a"), "b")


def families(ws: Workspace, least: DataFrame) -> DataFrame:
    """Links (a, b) of keys whose components are families: all keys that share a cell and have AGREE like minima are in one."""
    cells = least.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("cell"))
    # a table of its own, so that a cell of very many texts can be split in the join
    dense = cells.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high")
    dense = ws.put(dense.select("cell", F.ceil(F.col("n") / CELL_ROWS).alias("n")), "dense")
    rows = _dealt(cells.join(dense, "cell"), F.col("n")).drop("n")
    rows = rows.join(least.select("key", "sig"), "key").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")

    def compare(batches):
        for table, at in whole_groups(batches, ["cell", "lo", "hi"], 1 << 14):
            keys = table["key"].to_numpy()
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(keys), -1)
            begin, size = np.array(at[:-1]), np.diff(at)
            a, b = [], []
            for n in np.unique(size[size <= SMALL]).tolist():
                i, j = np.triu_indices(n, 1)
                firsts = begin[size == n]
                for some in np.array_split(firsts, -(-len(firsts) * len(i) // 100_000) or 1):
                    u, v = (some[:, None] + i).reshape(-1), (some[:, None] + j).reshape(-1)
                    ok = (sig[u] == sig[v]).sum(axis=1) >= AGREE
                    a.append(u[ok])
                    b.append(v[ok])
            for g in np.flatnonzero(size > SMALL).tolist():
                own = sig[at[g] : at[g + 1]]
                u, v = _walk(len(own), lambda x, left, own=own: (own[left] == own[x]).sum(axis=1) >= AGREE)
                a.append(u + at[g])
                b.append(v + at[g])
            yield _forest(keys, a, b)
        give_back()

    return rows.select("cell", "lo", "hi", "key", "sig").mapInArrow(compare, LINKS)


def _dealt(rows: DataFrame, k: Column) -> DataFrame:
    """rows (key, ...) with lo, hi: a group of k chunks (by a hash of the key) is dealt to pairs of chunks, so each row goes out k times."""
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("key"), k)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
    return rows.withColumn("lo", F.least("_own", "_o")).withColumn("hi", F.greatest("_own", "_o")).drop("_own", "_o")


def exact(sets: tuple[np.ndarray, np.ndarray], likeness: float = LIKENESS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the sets (grams, offsets) whose Jaccard likeness is ``likeness`` or more."""
    grams, at = sets
    size = np.diff(at)
    values, which = np.unique(grams, return_inverse=True)
    order = np.argsort(which, kind="stable")
    holder = np.repeat(np.arange(len(size)), size)[order]  # who has the first value, who has the second, ...
    count = np.bincount(which, minlength=len(values))
    first = np.cumsum(count) - count

    def alike(x: int, left: np.ndarray) -> np.ndarray:
        own = which[at[x] : at[x + 1]]
        shared = np.bincount(holder[spread(first[own], count[own])], minlength=len(size))[left]
        return shared / (size[left] + size[x] - shared) >= likeness

    return _walk(len(size), alike)


def links(ws: Workspace, docs: DataFrame, least: DataFrame, members: DataFrame, likeness: float = LIKENESS) -> DataFrame:
    """Links (a, b) of keys whose whole shingle sets are alike, among (key, family); docs is (doc_id, text)."""
    needed = ws.put(members.join(least.select("key", "doc_id", "size"), "key").select("key", "family", "size", F.col("doc_id").alias("_id")), "needed")
    chunks = ws.put(needed.groupBy("family").agg(F.ceil(F.sum("size") / FAMILY_SHINGLES).alias("n")), "chunks")
    ids = needed.select("_id").distinct()
    texts = docs.join(sent(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    texts = with_key(texts, False).withColumnRenamed("key", "_key").join(needed, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = ws.put(texts.select("key", "family", "text").dropDuplicates(["key"]), "texts")
    rows = _dealt(texts.join(chunks, "family"), F.col("n")).drop("n")
    rows = rows.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def compare(batches):
        for table, at in whole_groups(batches, ["family", "lo", "hi"], 1 << 10):
            keys, a, b = table["key"].to_numpy(), [], []
            for i, j in zip(at, at[1:], strict=False):
                u, v = exact(shingle_sets(*text_bytes(table["text"].slice(i, j - i).combine_chunks())), likeness)
                a.append(u + i)
                b.append(v + i)
            yield _forest(keys, a, b)
        give_back()

    return rows.select("family", "lo", "hi", "key", "text").mapInArrow(compare, LINKS)


def groups(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(rep_id, rep_key), one row for each group: its smallest doc_id (null: last) from docs (doc_id, text)."""
    printed = with_key(docs, True)
    least = printed.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "size", "fp", "bands", "sig")).alias("_l")).select("key", "_l.*")
    least = ws.put(least, "least")
    members = ws.put(components(ws, trie_links(ws, least).unionByName(families(ws, least)), "cf").select(F.col("node").alias("key"), F.col("root").alias("family")), "families")
    found = ws.put(links(ws, docs, least, members), "links")
    rooted = ws.put(components(ws, found, "cl"), "roots")
    named = least.select("key", "none", "doc_id").join(rooted, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))
    reps = named.groupBy("root").agg(F.min(F.struct("none", "doc_id", "key")).alias("rep")).select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
    reps = ws.put(reps, "reps")
    ws.keep("reps")
    return reps


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each group, with the columns of docs; one of repeated rows stays.

    Texts without words are alike; a null id stays only where a group has no other.
    """
    columns = docs.columns
    ws = Workspace(docs.sparkSession, "likeness")
    reps = groups(ws, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = docs.select(F.struct(*[c for c in columns if c != "text"]).alias("_row"), "text", F.col("doc_id").cast("bigint").alias("_id"))
    # Ids with one row, which names its group, stay as they are; only rows of other ids (repeated, or of a group with a smaller id) are looked at.
    ids = rows.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n"))
    named = reps.where("rep_id is not null").select("rep_id").distinct()
    other = ws.put(ids.join(named, F.col("_id") == F.col("rep_id"), "left").where("n > 1 or rep_id is null").select("_id"), "other")
    other = sent(other)
    plain = rows.where("_id is not null").join(other, "_id", "left_anti").select("_row", "text")
    looked = rows.join(other, "_id", "left_semi").unionByName(rows.where("_id is null"))
    looked = with_key(looked, False).join(reps, F.col("_id").eqNullSafe(F.col("rep_id")) & (F.col("key") == F.col("rep_key")), "left_semi")
    kept = plain.unionByName(looked.dropDuplicates(["_id", "key"]).select("_row", "text"))
    return kept.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])

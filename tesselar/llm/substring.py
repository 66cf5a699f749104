"""Operator 4: substring deduplication by a log-structured fingerprint index.

A window is WINDOW consecutive words. Of the hashes of the shorter runs of ANCHOR
words inside it, a window's anchor is the smallest, so equal windows have equal
anchors wherever they stand and neighbouring windows mostly share theirs: a text
has an anchor for some sixteen words. The index holds the anchors of historical
windows in sorted immutable runs, bucketed alike, so a new batch is merge-joined
with every run without a shuffle; then the batch becomes a run, and runs are
merged once there are more than RUNS of them.

Windows under an anchor that two texts share are verified by a 128-bit BLAKE2b
digest of their words' own bytes, in two steps. A segment is a run of windows with
one anchor: where a smaller doc_id has the same segment, all its windows are
settled at once. Only the first text with a segment goes on, window by window.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, blocks, give_back, gram_hashes, pieces_of, sent, small_batches, table, text_bytes, word_hashes, word_spans

WINDOW = 50
ANCHOR = 20
#: Runs that an index has at most between batches, and batches that one call adds documents in.
RUNS = 2
BATCHES = 4
#: Bytes of a bucket that more data get more buckets for.
BUCKET_BYTES = 64 << 20


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each of the n - window + 1 windows of words, across texts too."""
    low = gram_hashes(hashes, anchor)
    width = window - anchor + 1
    if len(low) < width:
        return np.empty(0, np.uint64)
    span = 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, tid: a hash of the text that tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))


def scan(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, tid, n_words, sha (of the words, one space between), anchors (distinct) of each row."""
    kinds = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("anchors", pa.list_(pa.int64()))])

    def read(batches):
        for block in blocks(batches):
            raw, ends = text_bytes(block.column(1))
            starts, stops, at = word_spans(raw, ends)
            low = anchors(word_hashes(raw, starts, stops), window, anchor).view(np.int64)
            data, cut, at = raw.tobytes(), ends.tolist(), at.tolist()
            plain = [b" ".join(data[a:b].split()) for a, b in zip(cut, cut[1:], strict=False)]
            each = [np.unique(low[a : b - window + 1]) if b - a >= window else low[:0] for a, b in zip(at, at[1:], strict=False)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, each)]).astype(np.int32), np.concatenate(each))
            columns = [block.column(0), block.column(2), pa.array(np.diff(at)), pa.array([hashlib.sha256(x).digest() for x in plain], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)
        give_back()

    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(read, "doc_id bigint, tid bigint, n_words bigint, sha binary, anchors array<bigint>")


def _joined(data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, one space between, and where each begins and ends."""
    to = np.cumsum(stops - starts + 1) - 1
    return b" ".join([data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]), to - (stops - starts), to


def _digests(words: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n x 2) signed integers: the digest of each stretch of the words' bytes."""
    made = b"".join([hashlib.blake2b(words[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def _rows(block: pa.RecordBatch, owner: np.ndarray, digest: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    took = pa.array(owner)
    columns = [pa.array(np.ascontiguousarray(digest[:, 0])), pa.array(np.ascontiguousarray(digest[:, 1])), block.column(0).take(took), block.column(2).take(took), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc_id", "tid", "first", "n"])


FOUND = "a bigint, b bigint, doc_id bigint, tid bigint, first int, n int"


def segments(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """a, b (digest of all words of a segment), doc_id, tid, first (word), n (windows) for segments of (doc_id, text, tid, hot array<bigint>) whose anchor is hot."""

    def emit(batches):
        for block in blocks(batches):
            raw, ends = text_bytes(block.column(1))
            starts, stops, at = word_spans(raw, ends)
            low = anchors(word_hashes(raw, starts, stops), window, anchor).view(np.int64)
            hot, owner = np.zeros(len(low) + 1, bool), np.repeat(np.arange(block.num_rows), np.diff(at))
            for i, known in enumerate(block.column(3)):
                if at[i + 1] - at[i] >= window:
                    own = slice(at[i], at[i + 1] - window + 1)
                    hot[own] = np.isin(low[own], known.values.to_numpy())
            on = np.flatnonzero(hot)
            if not len(on):
                continue
            new = np.ones(len(on), bool)
            new[1:] = (np.diff(on) != 1) | (low[on[1:]] != low[on[:-1]]) | (owner[on[1:]] != owner[on[:-1]])
            first = on[new]
            n = np.diff(np.append(np.flatnonzero(new), len(on)))
            words, begin, to = _joined(raw.tobytes(), starts, stops)
            yield _rows(block, owner[first], _digests(words, begin[first], to[first + n + window - 2]), first - at[owner[first]], n)
        give_back()

    return texts.select("doc_id", "text", "tid", "hot").mapInArrow(emit, FOUND)


def windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b (digest of a window's words), doc_id, tid, first, n = 1 for the windows of (doc_id, text, tid, runs array<struct<first, n>>)."""

    def emit(batches):
        for block in blocks(batches):
            raw, ends = text_bytes(block.column(1))
            starts, stops, at = word_spans(raw, ends)
            places, owner = [], []
            for i, runs in enumerate(block.column(3).to_pylist()):
                own = np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in runs]))
                places.append(own + at[i])
                owner.append(np.full(len(own), i))
            first, owner = np.concatenate(places), np.concatenate(owner)
            words, begin, to = _joined(raw.tobytes(), starts, stops)
            yield _rows(block, owner, _digests(words, begin[first], to[first + window - 1]), first - at[owner], np.ones(len(first)))
        give_back()

    return texts.select("doc_id", "text", "tid", "runs").mapInArrow(emit, FOUND)


class Buckets:
    """Tables of a folder that are bucketed and sorted by the same columns, so that joins on these need no shuffle."""

    def __init__(self, ws: Workspace, by: list[str], n: int):
        self.ws, self.by, self.n, self.names = ws, by, n, {}

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        known = self.names[name] = f"tesselar_{uuid.uuid4().hex}"
        writer = rows.repartition(self.n, *self.by).write.mode("overwrite").option("path", self.ws.path(name)).option("compression", "zstd")
        writer.bucketBy(self.n, *self.by).sortBy(*self.by).saveAsTable(known)
        return self.get(name)

    def adopt(self, name: str, schema: str) -> None:
        """Makes a table that an earlier session wrote known to this one."""
        known = self.names[name] = f"tesselar_{uuid.uuid4().hex}"
        by = ", ".join(self.by)
        self.ws.spark.sql(f"CREATE TABLE {known} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.n} BUCKETS LOCATION '{self.ws.path(name)}'")

    def get(self, name: str) -> DataFrame:
        return self.ws.spark.table(self.names[name])

    def drop(self, *names: str) -> None:
        for name in names:
            self.ws.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)}")
            self.ws.drop(name)


def bucket_count(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces_of(size, BUCKET_BYTES))


ENTRIES = "anchor bigint, doc_id bigint"


class FingerprintIndex:
    """Anchors (anchor, doc_id) of all texts seen so far, in sorted immutable runs.

    The list of runs is a small table of its own, written after them under the next
    number: what a failed writer leaves is not in any list. ``open`` goes on with
    the newest list of a folder, so that a later session adds its batches.
    """

    def __init__(self, ws: Workspace, most: int = RUNS, size: int = 0, buckets: int | None = None):
        self.ws, self.most, self.runs, self.made, self.version = ws, most, [], 0, 0
        self.tables = Buckets(ws, ["anchor"], buckets or bucket_count(ws.spark, size))

    @classmethod
    def open(cls, spark: SparkSession, root: str, most: int = RUNS, size: int = 0) -> FingerprintIndex:
        ws = Workspace.at(spark, root)
        versions = [int(name.split("-")[1]) for name in ws.names() if name.startswith("list-") and ws.whole(name)]
        if not versions:
            return cls(ws, most, size)
        held = spark.read.schema("run string, number int, buckets int, made int").parquet(ws.path(f"list-{max(versions)}")).orderBy("number").collect()  # at most RUNS rows
        index = cls(ws, most, buckets=held[0]["buckets"])
        index.runs, index.made, index.version = [r["run"] for r in held], held[0]["made"], max(versions)
        for name in index.runs:
            index.tables.adopt(name, ENTRIES)
        return index

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{self.made}"
        self.made += 1
        self.tables.put(rows, name)
        return name

    def commit(self) -> None:
        """Makes the runs the folder's state."""
        self.version += 1
        held = [(name, i, self.tables.n, self.made) for i, name in enumerate(self.runs)]
        self.ws.put(self.ws.spark.createDataFrame(held, "run string, number int, buckets int, made int").coalesce(1), f"list-{self.version}")

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds a batch (anchor, doc_id) and returns the entries, old or new, whose anchor a new text shares with another text."""
        name = self._write(rows)
        new = self.tables.get(name)
        keys = new.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        old = [self.tables.get(r).hint("merge").join(keys.select("anchor"), "anchor", "left_semi") for r in self.runs]
        hot = keys.where("low < high").select("anchor")
        for x in old:
            hot = hot.unionByName(x.select("anchor"))
        hot = self.ws.put(hot.distinct(), f"keys-{self.made}")
        matched = new.hint("merge").join(hot, "anchor", "left_semi")
        for x in old:
            matched = matched.unionByName(x)
        out = self.ws.put(matched.distinct(), f"hot-{self.made}")
        self.ws.drop(f"keys-{self.made}")
        self.runs.append(name)
        if len(self.runs) > self.most:
            self.compact()
        return out

    def compact(self) -> None:
        """Merges all runs into one."""
        rows = self.tables.get(self.runs[0])
        for r in self.runs[1:]:
            rows = rows.unionByName(self.tables.get(r))
        merged = self._write(rows)
        self.tables.drop(*self.runs)
        self.runs = [merged]


def repeated(ws: Workspace, docs: DataFrame, rows: DataFrame, index: FingerprintIndex, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Texts that share an anchor, bucketed by (doc_id, tid), and their (doc_id, tid, runs): windows that also start in a text with a smaller doc_id.

    ``rows`` has (doc_id, anchors) of the texts to add, which enter the index in
    order of doc_id, in batches; ``docs`` holds them and all that the index knows.
    Lists are gathered for one text at a time and never outgrow the text itself.
    """
    part = rows.where("size(anchors) > 0")
    cuts = part.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0]).alias("q")).first()["q"] or []
    edges = [None, *(sorted(set(cuts)) if batches > 1 else []), None]
    hot = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        some = part.where((F.lit(True) if lo is None else F.col("doc_id") > lo) & (F.lit(True) if hi is None else F.col("doc_id") <= hi))
        found = index.add(some.select(F.explode("anchors").alias("anchor"), "doc_id"))
        hot = found if hot is None else hot.unionByName(found)
    hot = ws.put(hot.groupBy("doc_id").agg(F.collect_set("anchor").alias("hot")), "hot")
    picked = _texts(docs).join(sent(hot.select("doc_id")), "doc_id", "left_semi").join(hot, "doc_id")
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tables = Buckets(ws, ["doc_id", "tid"], bucket_count(ws.spark, size))
    texts = tables.put(picked.select("doc_id", "tid", "text", "hot").dropDuplicates(["doc_id", "tid"]), "texts")
    found = ws.put(segments(texts, window, anchor), "segments")
    # tables of their own, so that a segment or window in very many texts can be split in the join
    least = ws.put(_least(found), "least-segment")
    found = ws.put(found.join(least, ["a", "b"], "left").withColumn("late", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).select("doc_id", "tid", "first", "n", "late"), "judged")
    open_ = found.where("not late").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    single = ws.put(windows(texts.join(open_, ["doc_id", "tid"]), window), "windows")
    least = ws.put(_least(single), "least-window")
    late = single.join(least, ["a", "b"]).where("doc_id > least").select("doc_id", "tid", "first", "n")
    late = found.where("late").select("doc_id", "tid", "first", "n").unionByName(late)
    late = ws.put(late.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "late")
    ws.drop("segments", "least-segment", "judged", "windows", "least-window", "hot")
    return texts, late


def _least(found: DataFrame) -> DataFrame:
    """(a, b, least): the smallest doc_id of what stands in two documents or more."""
    return found.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")


def analyse(ws: Workspace, docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, tid, n_words, sha, first: smallest doc_id with equal words) of docs, and ``repeated`` of the first ones."""
    scanned = ws.put(scan(docs, window, anchor), "scanned")
    # of texts that stand more than once; a table of its own, so that a text in very many rows can be split in the join
    least = ws.put(scanned.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "equal")
    rows = scanned.join(least, "sha", "left").withColumn("first", F.coalesce("first", "doc_id"))
    rows = ws.put(rows.withColumn("anchors", F.when(F.col("doc_id") == F.col("first"), F.col("anchors"))), "rows")
    ws.drop("scanned", "equal")
    own = index or FingerprintIndex(ws, size=8 * (rows.agg(F.sum("n_words")).first()[0] or 0) // 8)
    every = docs if history is None else history.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    texts, late = repeated(ws, every, rows.select("doc_id", "anchors"), own, batches, window, anchor)
    if index:
        index.commit()
    else:
        own.tables.drop(*own.runs)
    return rows.drop("anchors"), texts, late


def cut_words(words: list[bytes], runs: list[dict], window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that no window of the runs (first, n) covers, and how many are covered."""
    step = np.zeros(len(words) + 1, np.int64)
    first = np.array([r["first"] for r in runs], np.int64)
    np.add.at(step, first, 1)
    np.subtract.at(step, first + np.array([r["n"] for r in runs], np.int64) + window - 1, 1)
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return [words[i] for i in kept.tolist()], len(words) - len(kept)


def substring_report(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of documents (doc_id, text).

    A null text has no words, and texts of any length are read whole. Ids must be
    smaller, not equal: repeated rows and texts of one id do not remove each other.
    A row with a null id keeps its words and removes none. Other columns are ignored;
    an empty table gives no rows. With an ``index`` (see ``FingerprintIndex.open``)
    and the ``history`` of documents it knows, docs are the next batch: they are
    judged against history too, and the index is committed with them.
    """
    ws = Workspace(docs.sparkSession, "substring")
    rows, texts, late = analyse(ws, docs, batches, window, anchor, index, history)

    def report(batches_):
        for block in blocks(batches_):
            out = []
            for text, runs in zip(block.column(1).to_pylist(), block.column(3).to_pylist(), strict=True):
                kept, n = cut_words(text.encode().split(), runs, window)
                out.append((n, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], names=["doc_id", "tid", "n", "kept"])
        give_back()

    cut = texts.join(late, ["doc_id", "tid"]).select("doc_id", "text", "tid", "runs").mapInArrow(report, "doc_id bigint, tid bigint, n bigint, kept string")
    cut = ws.put(cut, "cut")
    ws.keep("rows", "cut")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    joined = rows.join(cut, ["doc_id", "tid"], "left")
    gone = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", F.lit(0)))
    kept = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha"))))
    return joined.select("doc_id", "n_words", gone.cast("bigint").alias("n_removed"), kept.alias("kept_sha256"))


def drop_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs, all columns, without the covered words; texts that lose none stay as they are, texts that lose all leave.

    Nulls, repeated rows, ids and empty tables as in ``substring_report``. Texts
    whose doc_id loses nothing are passed on without a shuffle.
    """
    columns = docs.columns
    ws = Workspace(docs.sparkSession, "substring-cut")
    rows, _, late = analyse(ws, docs, batches, window, anchor)
    copies = rows.where((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)).select("doc_id", "tid", F.lit(True).alias("copy")).distinct()
    verdicts = late.join(copies, ["doc_id", "tid"], "full").select(F.col("doc_id").alias("_d"), F.col("tid").alias("_t"), "runs", F.coalesce("copy", F.lit(False)).alias("copy"))
    verdicts = ws.put(verdicts, "verdicts")
    ws.keep("verdicts")
    ids = sent(verdicts.select("_d").distinct())
    others = [c for c in columns if c not in ("text", "n_chars")]
    own = F.col("doc_id").cast("bigint") == F.col("_d")
    plain = docs.join(ids, own, "left_anti").select(*columns)
    touched = docs.join(ids, own, "left_semi").select(F.struct(*others).alias("_row"), "text", F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_tid"))
    touched = touched.join(verdicts, (F.col("_id") == F.col("_d")) & (F.col("_tid") == F.col("_t")), "left").where("not coalesce(copy, false)").select("_row", "text", "runs")

    def cut(batches_):
        for block in blocks(batches_):
            out, gone = [], []
            for text, runs in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                if runs:
                    text = b" ".join(cut_words(text.encode().split(), runs, window)[0]).decode()
                out.append(text)
                gone.append(runs is not None and not text)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(out, pa.string()), pa.array(gone, pa.bool_())], names=["_row", "text", "_gone"])
        give_back()

    small_batches(docs.sparkSession)
    done = touched.mapInArrow(cut, StructType([touched.schema["_row"], touched.schema["text"]]).add("_gone", "boolean")).where("not _gone")
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    done = done.select(*[made[c].alias(c) if c in made else F.col("_row")[c].alias(c) for c in columns])
    return plain.unionByName(done)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


#: The same by ordinary SQL; quadratic in nothing, but it writes every window out.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
late AS (SELECT h.doc_id, list(h.i) AS starts FROM h JOIN m USING (h) WHERE h.doc_id > m.least GROUP BY h.doc_id),
covered AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda a: range(a, a + 50)))) AS c FROM late),
k AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(len(c), 0)::BIGINT AS n_removed,
             CASE WHEN c IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda x: NOT list_contains(c, x)), lambda x: w.w[x]) END AS kept FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

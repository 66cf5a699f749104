"""Operator 12: ranked lexical search over a bit-sliced impact index.

A posting's impact is (10^9 tf) div (1000 tf + 20 m), below 2^20. ``build`` writes a
row for each term of a segment: the documents that hold it, and for each of the 20
bits of their impacts a bitmap over these documents. ``search`` turns the slices into
bitmaps over the segment. A term's weight multiplies its slices by shifts and adds,
the terms of an item are added with carries, all on 64 documents a word. The highest
scores are found from the most significant slice down, a segment at a time; a task
keeps the best of its segments and a last ranking merges the tasks.

Null and empty texts have no terms and are never found; repeated rows and equal
doc_ids are documents of their own, ties of a score go by doc_id and a null one comes
last; rows of one item_id (null is one) are one item with the terms of all, an item
without terms finds nothing; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import terms
from .common import Workspace, blocks, give_back, small_batches, table, text_bytes, whole_groups

#: Bits of an impact.
BITS = 20
#: Documents of an item's result.
TOP = 50
#: Words of 64 documents that a bitmap operation touches at once, over all items or terms of a step.
WORDS = 1 << 15
#: Terms of a step.
TERMS = 512

POSTINGS = "segment bigint, term string, n bigint, documents binary, slices binary"
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def read(batches):
        n = all_terms = 0
        for block in blocks(batches):
            raw, ends = text_bytes(block.column(0))
            _, _, at = terms.term_spans(raw, ends)
            n, all_terms = n + int((np.diff(at) > 0).sum()), all_terms + int(at[-1])
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([all_terms])], names=["n", "l"])

    small_batches(docs.sparkSession)
    row = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(read, "n bigint, l bigint").agg(F.sum("n"), F.sum("l")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _frequencies(raw: np.ndarray, ends: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, where the postings of each begin, and the document and frequency of each posting; and the terms of every document."""
    n, parts = len(ends) - 1, []
    lengths = np.zeros(n, np.int64)
    for part, cut in terms.slices(raw, ends, most):
        part = terms.LOWER[part]
        starts, stops, at = terms.term_spans(part, cut)
        lengths += np.diff(at)
        order, cuts = terms.grouped(part, starts, stops)
        doc = np.repeat(np.arange(n), np.diff(at))[order]
        new = np.ones(len(order), bool)
        new[1:] = doc[1:] != doc[:-1]
        new[cuts[:-1][: len(order)]] = True
        lead = np.flatnonzero(new)
        first = order[cuts[:-1]]
        parts.append((terms.gather(part, starts[first], stops[first], pa.string()), np.searchsorted(lead, cuts), doc[lead], np.diff(np.append(lead, len(order)))))
    if len(parts) == 1:
        return *parts[0], lengths
    known = pa.chunked_array([p[0] for p in parts]).unique()
    term = np.concatenate([np.repeat(terms.places_of(p[0], known), np.diff(p[1])) for p in parts])
    doc, tf = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    pairs, which = np.unique(np.stack([term, doc]), axis=1, return_inverse=True)
    total = np.zeros(pairs.shape[1], np.int64)
    np.add.at(total, which.reshape(-1), tf)
    return known, np.searchsorted(pairs[0], np.arange(len(known) + 1)), pairs[1], total, lengths


def sizes_of(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms, where ``n`` documents have ``total`` terms."""
    if int(lengths.max(initial=0)) * 50 * n < 1 << 62:
        return 50 + (50 * lengths * n) // max(total, 1)
    return np.array([50 + (50 * x * n) // max(total, 1) for x in lengths.tolist()], np.int64)


def pack_slices(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The BITS bitmaps of each group of values, lowest bit first, packed end to end to whole bytes; and the byte where each group begins, with the end."""
    n = np.diff(cuts)
    to = np.concatenate([[0], np.cumsum(-(-n * BITS // 8))])
    bits = np.zeros(8 * to[-1], np.uint8)
    rank = np.arange(len(values)) - np.repeat(cuts[:-1], n)
    base, width = np.repeat(8 * to[:-1], n) + rank, np.repeat(n, n)
    for b in range(BITS):
        bits[base + b * width] = (values >> b) & 1
    return np.packbits(bits, bitorder="little"), to


def build(docs: DataFrame, ws: Workspace, n: int, total: int, name: str = "slices") -> DataFrame:
    """The index of (doc_id, text), written: for each segment a row with its doc_ids (term null) and a row a term."""
    kinds = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.binary()), ("slices", pa.binary())])

    segment_bytes, slice_bytes, most = terms.SEGMENT, terms.SLICE, terms.DOCUMENTS

    def read(batches):
        task, number = TaskContext.get().partitionId(), 0
        for rows in terms.segments(batches, segment_bytes, most):
            segment = terms.segment_number(task, number)
            number += 1
            rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()  # nulls last: bits ascend with ids
            ids = rows["doc_id"].combine_chunks()
            raw, ends = text_bytes(rows["text"].combine_chunks())
            names, cuts, doc, tf, lengths = _frequencies(raw, ends, slice_bytes)
            if not len(names):
                continue
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * sizes_of(lengths, n, total)[doc])
            slices, at = pack_slices(impact, cuts)
            data, to = terms.pack_numbers(terms.ascending(doc, cuts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), segment)), names, pa.array(np.diff(cuts)), terms.lists_of(to[cuts], data), terms.lists_of(at, slices)], schema=kinds)
            own = [ids.fill_null(0).to_numpy().tobytes(), np.packbits(ids.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.nulls(1, pa.string()), pa.array([len(ids)]), pa.array([own[0]], pa.binary()), pa.array([own[1]], pa.binary())], schema=kinds)
        give_back()

    small_batches(docs.sparkSession)
    return ws.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, POSTINGS), name)


# --- arithmetic on bitmaps: slice s of an array holds bit s of every document's number ---


def add(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """total += more << shift, slice by slice with a carry. Slices beyond the last must not be needed."""
    carry = np.zeros(total.shape[1:], np.uint64)
    for s in range(len(more)):
        a, b = total[s + shift], more[s]
        half = a ^ b
        total[s + shift], carry = half ^ carry, (a & b) | (carry & half)
    for s in range(len(more) + shift, len(total)):
        if not carry.any():
            break
        total[s], carry = total[s] ^ carry, total[s] & carry


def times(slices: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(BITS, terms, words) slices times a weight a term, by shifts and adds."""
    high = int(weights.max(initial=0)).bit_length()
    out = np.zeros((BITS + high, *slices.shape[1:]), np.uint64)
    for b in range(high):
        on = (weights >> b) & 1 == 1
        if on.any():
            part = out[:, on]
            add(part, slices[:, on], b)
            out[:, on] = part
    return out


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """(items, words) bitmap of the k highest scores above 0 of each item, from the most significant slice down; ties go to lower bits."""
    sure = np.zeros(scores.shape[1:], np.uint64)
    open_ = np.bitwise_or.reduce(scores, axis=0)
    have = np.zeros(len(sure), np.int64)
    for s in range(len(scores) - 1, -1, -1):
        high = open_ & scores[s]
        n = have + np.bitwise_count(high).sum(axis=1, dtype=np.int64)
        over = (n > k)[:, None]
        sure |= np.where(over, np.uint64(0), high)
        have = np.where(n > k, have, n)
        open_ = np.where(over, high, open_ & ~scores[s])
    ties = np.unpackbits(open_.view(np.uint8), axis=1, bitorder="little")
    ties &= np.cumsum(ties, axis=1, dtype=np.int64) <= (k - have)[:, None]
    return sure | np.packbits(ties, axis=1, bitorder="little").view(np.uint64)


class Segment:
    """Bitmaps of a segment's documents, from the rows of a block's terms."""

    def __init__(self, rows: pa.Table, known: pa.Array):
        ids = rows.filter(rows["term"].is_null())
        lists = rows.filter(rows["term"].is_valid())
        self.n = ids["n"][0].as_py()
        self.ids = np.frombuffer(ids["documents"][0].as_py(), np.int64)
        self.valid = np.unpackbits(np.frombuffer(ids["slices"][0].as_py(), np.uint8), bitorder="little")[: self.n].astype(bool)
        self.words = -(-self.n // 64)
        self.term = terms.places_of(lists["term"].combine_chunks(), known)
        self.counts = lists["n"].to_numpy()
        raw, ends = text_bytes(lists["documents"].combine_chunks())
        self.cuts = np.concatenate([[0], np.cumsum(self.counts)])
        self.documents = terms.summed(terms.unpack_numbers(raw), self.cuts)
        self.slices, self.at = text_bytes(lists["slices"].combine_chunks())

    def bitmaps(self, which: list[int]) -> np.ndarray:
        """(BITS, terms, words) slices of the rows' impacts over all documents."""
        flat = np.zeros((BITS, len(which), 64 * self.words), np.uint8)
        for j, i in enumerate(which):
            own = self.documents[self.cuts[i] : self.cuts[i + 1]]
            flat[:, j, own] = np.unpackbits(self.slices[self.at[i] : self.at[i + 1]], bitorder="little", count=BITS * len(own)).reshape(BITS, -1)
        return np.packbits(flat, axis=2, bitorder="little").view(np.uint64)

    def best(self, pairs: np.ndarray, weights: np.ndarray, k: int, words: int = WORDS, terms_: int = TERMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of the k highest of each item; ``pairs`` are all (item, term) in ascending order."""
        row = np.full(len(weights), -1, np.int64)
        row[self.term] = np.arange(len(self.term))
        mine = pairs[:, row[pairs[1]] >= 0]
        items, number = np.unique(mine[0], return_inverse=True)
        step, found = max(1, words // self.words), []
        for first in range(0, len(items), step):
            here = (number >= first) & (number < first + step)
            who, term = number[here] - first, mine[1, here]
            limit = np.zeros(min(step, len(items) - first), np.float64)
            np.add.at(limit, who, weights[term] * float(1 << BITS))
            scores = np.zeros((int(limit.max()).bit_length() + 1, len(limit), self.words), np.uint64)
            named = np.unique(term)
            width = max(1, min(terms_, words // self.words))
            for t in range(0, len(named), width):
                chunk = named[t : t + width]
                made = times(self.bitmaps(row[chunk].tolist()), weights[chunk])
                own = np.flatnonzero((term >= chunk[0]) & (term <= chunk[-1]))
                w, at = who[own], np.searchsorted(chunk, term[own])
                turn = np.arange(len(w)) - np.searchsorted(w, w)  # an item's terms one after another, all items at once
                for j in range(int(turn.max()) + 1):
                    on = turn == j
                    part = scores[:, w[on]]
                    add(part, made[:, at[on]])
                    scores[:, w[on]] = part
            top = np.unpackbits(highest(scores, k).view(np.uint8), axis=1, bitorder="little")
            i, d = np.nonzero(top)
            value = np.zeros(len(i), np.int64)
            for s in range(len(scores)):
                value |= ((scores[s, i, d >> 6] >> (d & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
            found.append((items[first + i], d, value))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _first(item: np.ndarray, score: np.ndarray, valid: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores of each item."""
    order = np.lexsort((doc, ~valid, -score, item))
    own = item[order]
    return order[np.arange(len(order)) - np.searchsorted(own, own) < k]


def search_block(postings: DataFrame, items: list[tuple], n: int, k: int = TOP) -> DataFrame:
    """(number, doc_id, score): the k highest scores of a block of items (each a number and its terms)."""
    known = sorted({t for _, ts in items for t in ts})
    place = {t: i for i, t in enumerate(known)}
    lists = terms.listed(postings.where("term is not null"), known)
    held = {r[0]: r[1] for r in lists.groupBy("term").agg(F.sum("n")).toLocalIterator()}
    df = np.array([held.get(t, 0) for t in known], np.float64)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    pairs = np.array(sorted((i, place[t]) for i, ts in items for t in set(ts) if weights[place[t]] > 0), np.int64).reshape(-1, 2).T
    names, out = pa.array(known, pa.string()), pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    sizes = WORDS, TERMS

    def score(batches):
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]
        for rows, cuts in whole_groups(batches, ["segment"], 1):
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = Segment(rows.slice(a, b - a), names)
                i, d, s = own.best(pairs, weights, k, *sizes)
                best = [np.concatenate(x) for x in zip(best, (i, s, own.valid[d], own.ids[d]), strict=True)]
                stay = _first(*best, k)
                best = [x[stay] for x in best]
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[3], mask=~best[2]), pa.array(best[1])], schema=out)

    both = lists.select(*postings.columns).unionByName(postings.where("term is null"))
    return both.repartition("segment").sortWithinPartitions("segment").mapInArrow(score, "number bigint, doc_id bigint, score bigint")


def search(postings: DataFrame, items: DataFrame, ws: Workspace, n: int, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of every item (item_id, text)."""
    found = postings.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    joined = items.groupBy("item_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    for b, block in enumerate(terms.blocks_of_items(joined, ws)):
        asked = [(i, ts) for i, ts in enumerate(terms.terms_of([t for _, t in block])) if ts]
        if asked:
            names = postings.sparkSession.createDataFrame([(i, block[i][0]) for i, _ in asked], "number bigint, item_id bigint")
            hits = search_block(postings, asked, n, k).join(F.broadcast(names), "number").select("item_id", "doc_id", "score")
            found = found.unionByName(ws.put(hits, f"hits{b}"))
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of each benchmark item."""
    ws, docs = Workspace(spark, "bitslices"), table(spark, sf_dir, "documents")
    n, total = totals(docs)
    return search(build(docs, ws, n, total), table(spark, sf_dir, "benchmark"), ws, n)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
t AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), t),
s AS (
  SELECT b.item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), t GROUP BY 1, 2
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

"""Operator 11: benchmark decontamination by a distributed positional inverted index.

``build`` stores every term of every text: a row holds the ascending positions of
one term in one segment (``terms``), which the documents of the segment share with
a gap between two. ``matches`` finds phrases: in each segment the lists of a
phrase's terms are intersected from the rarest on, each moved by the term's place in
the phrase. ``near`` finds documents that hold all terms of an item close together.

Null and empty texts have no words; repeated rows and equal doc_ids, null ones too,
are documents of their own; other columns are ignored. An item without words has
no window, an item with a null item_id is not looked for, rows of one item_id are
one item with the windows of all. Empty tables give empty results, or documents
without hits. A text of any length is one document of one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .common import Workspace, give_back, small_batches, table, text_bytes, whole_groups

#: Words of a window.
WINDOW = 10
#: Starts that are checked at once.
STARTS = 1 << 20
#: Bits of a position in a segment.
PLACE = 40

POSTINGS = "segment bigint, term string, number int, doc_id bigint, at bigint, n bigint, positions binary"


def _rows(segment: int, n: int, term=None, number=None, doc_id=None, at=None, count=None, positions=None) -> pa.RecordBatch:
    kinds = [("segment", pa.int64()), ("term", pa.string()), ("number", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("positions", pa.binary())]
    columns = [pa.array(np.full(n, segment)), term, number, doc_id, at, count, positions]
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def build(docs: DataFrame, ws: Workspace, name: str = "postings") -> DataFrame:
    """The index of (doc_id, text), written: for each segment a row a document (term null; its ``number`` there, ``at`` its first position, ``n`` its words) and a row a term."""

    segment_bytes, slice_bytes, most = terms.SEGMENT, terms.SLICE, terms.DOCUMENTS

    def read(batches):
        task, number = TaskContext.get().partitionId(), 0
        for rows in terms.segments(batches, segment_bytes, most):
            segment = terms.segment_number(task, number)
            number += 1
            raw, ends = text_bytes(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0))
            counts, before = np.zeros(rows.num_rows, np.int64), 0
            for part, cut in terms.slices(raw, ends, slice_bytes):
                part = terms.LOWER[part]
                starts, stops, at = terms.term_spans(part, cut)
                own = np.diff(at)
                place = np.arange(len(starts)) + np.repeat(np.arange(rows.num_rows), own) + before
                counts += own
                before += len(starts)
                order, cuts = terms.grouped(part, starts, stops)
                if len(order):
                    data, to = terms.pack_numbers(terms.ascending(place[order], cuts))
                    first = order[cuts[:-1]]
                    yield _rows(segment, len(first), terms.gather(part, starts[first], stops[first], pa.string()), count=pa.array(np.diff(cuts)), positions=terms.lists_of(to[cuts], data))
            at = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
            yield _rows(segment, rows.num_rows, number=pa.array(np.arange(rows.num_rows, dtype=np.int32)), doc_id=rows["doc_id"].combine_chunks(), at=pa.array(at), count=pa.array(counts))
        give_back()

    small_batches(docs.sparkSession)
    return ws.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, POSTINGS), name)


@dataclass
class Windows:
    """Distinct windows of a block of items: term numbers (-1 beyond the end), and the items of each."""

    terms: list[str]
    rows: np.ndarray
    sizes: np.ndarray
    items: np.ndarray
    cuts: np.ndarray


def windows_of(items: list[tuple], window: int = WINDOW) -> Windows:
    known, made = {}, {}
    for (item, _), words in zip(items, terms.terms_of([t for _, t in items]), strict=True):
        if item is None or not words:
            continue
        numbers = [known.setdefault(w, len(known)) for w in words]
        for i in range(max(1, len(numbers) - window + 1)):
            made.setdefault(tuple(numbers[i : i + window]), set()).add(item)
    rows = np.full((len(made), window), -1, np.int64)
    for i, w in enumerate(made):
        rows[i, : len(w)] = w
    owners = [sorted(x) for x in made.values()]
    return Windows(list(known), rows, (rows >= 0).sum(axis=1), np.array([i for x in owners for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64))


def _lists(rows: pa.Table, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All (term, position) of a segment in one ascending array, and how many positions each known term has."""
    term, counts, keys = terms.places_of(rows["term"].combine_chunks(), known), np.zeros(len(known), np.int64), []
    n = rows["n"].to_numpy()
    blobs = rows["positions"].combine_chunks()
    raw, _ = text_bytes(blobs)
    cuts = np.concatenate([[0], np.cumsum(n)])
    np.add.at(counts, term, n)
    keys = (np.repeat(term, n) << PLACE) | terms.summed(terms.unpack_numbers(raw), cuts)
    return np.sort(keys), counts


def _starts(keys: np.ndarray, counts: np.ndarray, w: Windows, most: int = STARTS) -> tuple[np.ndarray, np.ndarray]:
    """(window, position of its first word) of every occurrence in a segment."""
    rows, inside = np.maximum(w.rows, 0), w.rows >= 0
    have = np.where(inside, counts[rows], np.iinfo(np.int64).max)
    live = np.flatnonzero((have > 0).all(axis=1))
    rank = np.argsort(have[live], axis=1, kind="stable")
    begin = np.concatenate([[0], np.cumsum(counts)])
    rarest = have[live, rank[:, 0]] if len(live) else np.empty(0, np.int64)
    block = np.cumsum(rarest) // most
    found = []
    for b in np.unique(block).tolist():
        own = np.flatnonzero(block == b)
        n = rarest[own]
        who = np.repeat(own, n)
        off = rank[who, 0]
        at = begin[rows[live[who], off]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = (keys[at] & ((1 << PLACE) - 1)) - off
        who, start = who[start >= 0], start[start >= 0]
        for k in range(1, w.rows.shape[1]):
            if not len(who):
                break
            off = rank[who, k]
            check = w.sizes[live[who]] > k
            want = (rows[live[who], off] << PLACE) | (start + off)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            stay = ~check | (keys[at] == want)
            who, start = who[stay], start[stay]
        found.append((live[who], start))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


FOUND = "segment bigint, number int, spans array<struct<start: bigint, stop: bigint>>, items array<bigint>"


def _structs(cuts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(cuts.astype(np.int32), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]))


def _hits(segment: int, docs: np.ndarray, window: np.ndarray, start: np.ndarray, w: Windows) -> pa.RecordBatch:
    """A row for each document with hits: its hit words as spans, and the items."""
    doc = np.searchsorted(docs, start, side="right") - 1
    order = np.lexsort((start, doc))
    d, a, b = doc[order], start[order], (start + w.sizes[window])[order]
    reach = np.maximum.accumulate(b)  # documents ascend with positions
    new = np.ones(len(d), bool)
    new[1:] = (a[1:] > reach[:-1]) | (d[1:] != d[:-1])
    lead = np.flatnonzero(new)
    who, cuts = np.unique(d[lead], return_index=True)
    spans = _structs(np.append(cuts, len(lead)), a[lead] - docs[d[lead]], np.append(reach[lead[1:] - 1], reach[-1]) - docs[d[lead]])
    both = np.unique(np.stack([doc, window]), axis=1)
    n = np.diff(w.cuts)[both[1]]
    item = w.items[np.repeat(w.cuts[both[1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    pairs = np.unique(np.stack([np.repeat(both[0], n), item]), axis=1)
    ends = np.append(np.searchsorted(pairs[0], who), pairs.shape[1]).astype(np.int32)
    columns = [pa.array(np.full(len(who), segment)), pa.array(who.astype(np.int32)), spans, pa.ListArray.from_arrays(ends, pa.array(pairs[1]))]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "number", "spans", "items"])


def _by_segment(postings: DataFrame, names: list[str], look, schema: str) -> DataFrame:
    """Calls ``look`` with each segment's id, first positions and words of its documents and lists of the named terms."""
    known = pa.array(names, pa.string())

    def read(batches):
        for rows, cuts in whole_groups(batches, ["segment"], 1):
            for a, b in zip(cuts, cuts[1:], strict=False):
                one = rows.slice(a, b - a)
                own = one.filter(one["term"].is_null()).sort_by("number")
                lists = one.filter(one["term"].is_valid())
                if lists.num_rows and own.num_rows:
                    keys, counts = _lists(lists, known)
                    yield from look(one["segment"][0].as_py(), own["at"].to_numpy(), own["n"].to_numpy(), keys, counts)
        give_back()

    both = terms.listed(postings.where("term is not null"), names).select(*postings.columns).unionByName(postings.where("term is null"))
    return both.repartition("segment").sortWithinPartitions("segment").mapInArrow(read, schema)


def matches(postings: DataFrame, items: list[tuple], window: int = WINDOW) -> DataFrame:
    """Documents (segment, number) with a window of the items (item_id, text): ``spans`` of words that occurrences cover, ``items`` with occurring windows.

    Windows are ``window`` words in a row; an item of fewer words is one window.
    """
    w = windows_of(items, window)
    if not w.terms:
        return postings.sparkSession.createDataFrame([], FOUND)

    most = STARTS

    def look(segment, at, n, keys, counts):
        who, start = _starts(keys, counts, w, most)
        if len(who):
            yield _hits(segment, at, who, start, w)

    return _by_segment(postings, w.terms, look, FOUND)


CLOSE = "segment bigint, number int, item_id bigint, start bigint, stop bigint"


def near(postings: DataFrame, items: list[tuple], within: int) -> DataFrame:
    """(segment, number, item_id, start, stop): the shortest spans of at most ``within`` words that hold all terms of an item, in any order.

    A span is shortest if no other one that holds all terms lies in it.
    """
    known, asked = {}, []
    for (item, _), words in zip(items, terms.terms_of([t for _, t in items]), strict=True):
        if item is not None and words:
            asked.append((item, np.array(sorted({known.setdefault(x, len(known)) for x in words}), np.int64)))
    if not known:
        return postings.sparkSession.createDataFrame([], CLOSE)
    mask = (1 << PLACE) - 1

    def look(segment, at, n, keys, counts):
        begin, out = np.concatenate([[0], np.cumsum(counts)]), []
        for item, own in asked:
            if not counts[own].all():
                continue
            lists = [keys[begin[t] : begin[t + 1]] & mask for t in own[np.argsort(counts[own], kind="stable")].tolist()]
            live = lists[0]
            for other in lists[1:]:  # the rarest term's places that have every other term near
                live = live[np.searchsorted(other, live - within, side="right") < np.searchsorted(other, live + within, side="left")]
            around = np.unique(np.concatenate([x[_close(x, live, within)] for x in lists])) if len(live) else live
            start, good = around.copy(), np.ones(len(around), bool)
            for other in lists:  # the last place of each term up to an end
                i = np.searchsorted(other, around, side="right") - 1
                good &= i >= 0
                start = np.minimum(start, other[np.maximum(i, 0)])
            doc = np.searchsorted(at, around, side="right") - 1
            good &= (around - start < within) & (start >= at[doc])
            stop, start, doc = around[good], start[good], doc[good]
            short = np.ones(len(stop), bool)
            short[1:] = start[1:] != start[:-1]  # a later end of one start is longer
            out += [(segment, int(d), item, int(a - at[d]), int(b - at[d]) + 1) for a, b, d in zip(start[short], stop[short], doc[short], strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["segment", "number", "item_id", "start", "stop"]).cast(pa.schema([("segment", pa.int64()), ("number", pa.int32()), ("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))

    return _by_segment(postings, list(known), look, CLOSE)


def _close(x: np.ndarray, live: np.ndarray, within: int) -> np.ndarray:
    """Which places lie less than ``within`` from one of the live ones."""
    return np.searchsorted(live, x - within, side="right") < np.searchsorted(live, x + within, side="left")


def documents_of(postings: DataFrame) -> DataFrame:
    """segment, number, doc_id, n_words of each indexed document."""
    return postings.where("term is null").select("segment", "number", "doc_id", F.col("n").alias("n_words"))


def _merged(spans: Column) -> Column:
    """Spans of several blocks, sorted and joined where they meet."""
    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= x["start"]), joined).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,stop:bigint>>"), add)


def contaminated(docs: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (of hit words), items (sorted item_ids) for every document (doc_id, text) against all items (item_id, text)."""
    postings = build(docs, ws)
    found = []
    for i, block in enumerate(terms.blocks_of_items(items, ws)):
        found.append(ws.put(matches(postings, block, window), f"matches{i}"))
    out = documents_of(postings)
    if not found:
        hits = postings.sparkSession.createDataFrame([], FOUND)
    elif len(found) == 1:
        hits = found[0]
    else:
        hits = found[0]
        for x in found[1:]:
            hits = hits.unionByName(x)
        hits = hits.groupBy("segment", "number").agg(_merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.join(hits, ["segment", "number"], "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    got = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "decontamination"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), b AS (
  SELECT DISTINCT id AS item_id, size, array_to_string(words[i : i + size - 1], ' ') AS win
  FROM (SELECT id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM w WHERE side = 'b' AND len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM b), hits AS (
  SELECT d.id AS doc_id, d.i, d.size, b.item_id
  FROM (SELECT id, size, i, array_to_string(words[i : i + size - 1], ' ') AS win
        FROM (SELECT id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE side = 'd' AND len(words) >= size)) d
  JOIN b ON b.size = d.size AND b.win = d.win
), n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY 1)
SELECT w.id AS doc_id, CAST(coalesce(len(words), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id WHERE side = 'd'
"""

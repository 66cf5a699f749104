"""Terms of texts, and postings of whole segments, for the two inverted indexes.

A term is a maximal run of letters and digits of ASCII and of all other code
points from U+0080 on; A-Z count as a-z. A segment is a run of whole documents of
about SEGMENT bytes, read by one task: what an index looks up or intersects meets
inside a segment, so no list of a frequent term is ever brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, _offsets, text_bytes, unequal, word_hashes

#: Bytes of text in a segment (one document may have more), and of a slice that is tokenized at once.
SEGMENT = 8 << 20
SLICE = 8 << 20
#: Documents in a segment.
DOCUMENTS = 1 << 13
#: Bytes of item texts in a block of queries: what the driver holds and sends to tasks at a time.
BLOCK = 8 << 20

INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each term, and the n + 1 offsets of texts into the terms."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = INSIDE[raw]
    left, right = ~inside[:-2], ~inside[2:]
    full = ends[:-1] < ends[1:]
    left[ends[:-1][full]] = True
    right[ends[1:][full] - 1] = True
    own = inside[1:-1]
    starts = np.flatnonzero(own & left)
    return starts, np.flatnonzero(own & right) + 1, np.searchsorted(starts, ends)


def gather(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of the stretches of bytes."""
    n = stops - starts
    ends = np.concatenate([[0], np.cumsum(n)])
    data = raw[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], n)]
    return pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def grouped(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by term: their numbers, term by term and ascending in each, and where each term begins, with the end.

    A hash sorts the words; their bytes are then compared, so no two terms are taken for one.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = (word_hashes(raw, starts, stops) >> bits) << bits
    key = np.sort(key | np.arange(n, dtype=np.uint64))
    order = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (key[1:] >> bits) != (key[:-1] >> bits)
    cuts = np.append(np.flatnonzero(new), n)
    head = np.repeat(order[cuts[:-1]], np.diff(cuts))
    bad = unequal(raw, starts[order], stops[order], starts[head], stops[head])
    if bad.any():  # different words under one hash: those groups are ordered by their bytes
        data, group = raw.tobytes(), np.cumsum(new) - 1
        for g in np.unique(group[bad]).tolist():
            a, b = int(cuts[g]), int(cuts[g + 1])
            own = sorted(order[a:b].tolist(), key=lambda i: (data[starts[i] : stops[i]], i))
            order[a:b] = own
            new[a + 1 : b] = [data[starts[i] : stops[i]] != data[starts[j] : stops[j]] for i, j in zip(own[1:], own, strict=False)]
        cuts = np.append(np.flatnonzero(new), n)
    return order, cuts


def segments(batches: Iterator[pa.RecordBatch], most: int, documents: int, column: str = "text") -> Iterator[pa.Table]:
    """Whole rows of a task in tables of about ``most`` bytes of text, or one row, and at most ``documents`` rows."""
    held, size, n = [], 0, 0
    for batch in batches:
        first = 0
        ends = _offsets(batch.column(batch.schema.get_field_index(column))) if batch.num_rows else None
        while first < batch.num_rows:
            last = min(max(int(np.searchsorted(ends, ends[first] + most - size, side="right")) - 1, first), batch.num_rows, first + documents - n)
            if last == first and not held:
                last = first + 1
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last] - ends[first])
                n += last - first
            if last < batch.num_rows or size >= most or n >= documents:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, n = [], 0, 0
            first = last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def slices(raw: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and text offsets of stretches of about ``most`` bytes that cut no term; a text may go on in the next."""
    at = 0
    while at < len(raw) or at == 0:
        to = min(len(raw), at + most)
        while to < len(raw):  # back to a byte outside terms, else on to the next one
            gaps = np.flatnonzero(~INSIDE[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(raw), to + most)
        yield raw[at:to], np.clip(ends, at, to) - at
        at = max(to, 1)


def segment_number(task: int, number: int) -> int:
    """An id of a task's segment; a task that runs again gives the same."""
    return (task << 32) | number


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, low ones first, the last one's top bit clear; and the n + 1 offsets of numbers into the bytes."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    top = int(v.max(initial=0)).bit_length()
    for k in range(7, max(top, 1), 7):
        n += v >> np.uint64(k) > 0
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k) if k else slice(None)
        part = (v[on] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[:-1][on] + k] = part | ((n[on] > k + 1).astype(np.uint8) << 7)
    return out, ends


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    n, out = last - first + 1, np.zeros(len(last), np.uint64)
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k) if k else np.arange(len(n))
        out[on] |= (data[first[on] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def ascending(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Differences inside each group of ascending numbers; the first of a group stays."""
    out = np.diff(values, prepend=0)
    out[cuts[:-1]] = values[cuts[:-1]]
    return out


def summed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The inverse of ``ascending``."""
    total = np.cumsum(values)
    base = np.concatenate([[0], total])[cuts[:-1]]
    return total - np.repeat(base, np.diff(cuts))


def lists_of(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie end to end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def terms_of(texts: list[str | None]) -> list[list[str]]:
    """Terms of each text, in order; a null text has none."""
    raw, ends = text_bytes(pa.array(texts, pa.large_string()))
    raw = LOWER[raw]
    starts, stops, at = term_spans(raw, ends)
    data = raw.tobytes()
    found = [data[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    return [found[a:b] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]


def blocks_of_items(items: DataFrame, ws: Workspace, most: int = 0) -> Iterator[list[tuple]]:
    """Items (item_id, text) on the driver in blocks of about ``most`` bytes of text, or one item: a query set of any size is met block by block."""
    rows = ws.put(items.select("item_id", "text"), "items")
    held, size = [], 0
    for row in rows.toLocalIterator():
        n = len(row["text"] or "") * 4
        if held and size + n > (most or BLOCK):
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield held


def listed(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the terms, which a block of queries bounds, picked in the scan."""
    names = postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return postings.join(F.broadcast(names), "term", "left_semi")


def places_of(terms: pa.Array, known: pa.Array) -> np.ndarray:
    """The number of each term among the known ones."""
    return pc.index_in(terms, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)

"""Ascending numbers as bytes: what posting lists are made of."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
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


def unpack(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    n, out = last - first + 1, np.zeros(len(last), np.uint64)
    for k in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > k) if k else np.arange(len(n))
        out[on] |= (data[first[on] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def steps(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Differences inside each group of ascending numbers; the first of a group stays."""
    out = np.diff(values, prepend=0)
    out[cuts[:-1]] = values[cuts[:-1]]
    return out


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The inverse of ``steps``."""
    total = np.cumsum(values)
    base = np.concatenate([[0], total])[cuts[:-1]]
    return total - np.repeat(base, np.diff(cuts))


def binaries(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie end to end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, end to end, and the n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]

"""Token ids of whole texts, word by word.

The tokenizer's normaliser and splitter never join anything across ASCII white
space, so the ids of a text are those of its words end to end. Words repeat,
texts do not, so each worker keeps the ids of words it has met. It looks up each
different word of a block once, by a hash, compares the words' bytes on a hit, and
lays the ids out with numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import FIRST_BYTES, LONG, blocks, distinct_words, give_back, lanes_of, text_bytes, word_spans

#: Id that ends every document.
END = np.uint32(1).tobytes()
#: Bytes of a generation of words and ids that a worker keeps; there are two.
CACHE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
#: Between words that are encoded together: a character that is one token by itself and joins no other.
MARK = "`"
TOGETHER = 64


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Known:
    """Words and their ids in arrays sorted by the words' hashes, which are distinct; words have at most LONG bytes."""

    def __init__(self):
        self.hashes, self.data, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint32)
        self.begin, self.first, self.size, self.count = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8), np.empty(0, np.uint16)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def find(self, hashes: np.ndarray, lanes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those that are not known: of equal hash, length and bytes."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ok, own = (self.hashes[at] == hashes) & (self.size[at] == size), lanes_of(self.data)
        for k in range(0, LONG, 8):
            on = np.flatnonzero(ok & (size > k))
            if not len(on):
                break
            ok[on] = ((own[self.begin[at[on]] + k] ^ lanes[starts[on] + k]) & FIRST_BYTES[np.minimum(size[on] - k, 8)]) == 0
        return np.where(ok, at, -1)

    def add(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Adds words of ascending hashes with the ids of each, end to end; a hash that is known already keeps its word."""
        at = np.searchsorted(self.hashes, hashes)
        first = np.cumsum(count) - count + len(self.ids)
        new = np.ones(len(hashes), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
        at, starts, size = at[new], starts[new], size[new]
        begin = np.cumsum(size) - size + len(self.data)
        for name, values in (("hashes", hashes[new]), ("begin", begin), ("first", first[new]), ("size", size), ("count", count[new])):
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.data, self.ids = np.concatenate([self.data, raw[spread(starts, size)]]), np.concatenate([self.ids, ids])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids, end to end, of words at places."""
        count = self.count[at].astype(np.int64)
        return count, self.ids[spread(self.first[at], count)]


class WordIds:
    """Packed little-endian unsigned 32-bit ids of texts.

    Words met since the last change of generation are young; when they take
    ``most`` bytes they become the old ones, and old words that are met again
    become young, so frequent words stay.
    """

    def __init__(self, path: str, most: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.young, self.old = Tokenizer.from_file(path), most, Known(), Known()
        self.mark = self._encode([MARK])[0]
        if len(self.mark) != 1:
            raise ValueError("the mark must be one token")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids, end to end, of words; words with the mark in them are encoded one by one."""
        plain = [w for w in words if MARK not in w]
        joined = [f" {MARK} ".join(plain[i : i + TOGETHER]) + f" {MARK}" for i in range(0, len(plain), TOGETHER)]
        flat = np.array([x for ids in self._encode(joined) for x in ids], np.uint32)
        ends = np.flatnonzero(flat == self.mark[0])
        counts, ids = np.diff(ends, prepend=-1) - 1, np.delete(flat, ends)
        if len(plain) == len(words):
            return counts, ids
        odd = iter(self._encode([w for w in words if MARK in w]))
        each = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(plain) else [])
        all_ids = [np.array(next(odd), np.uint32) if MARK in w else next(each) for w in words]
        return np.array([len(x) for x in all_ids], np.int64), np.concatenate(all_ids)

    def _ids(self, raw: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids, end to end, of different words; those that are long, or share a hash with another, are not kept."""
        if self.young.nbytes > self.most:
            self.old, self.young = self.young, Known()
        size, lanes, data = stops - starts, lanes_of(raw), raw.tobytes()
        fit = np.flatnonzero((size <= LONG) & (hashes[1:] > hashes[:-1]).all())
        lost = fit[self.young.find(hashes[fit], lanes, starts[fit], size[fit]) < 0]
        place = self.old.find(hashes[lost], lanes, starts[lost], size[lost])
        again, new = lost[place >= 0], lost[place < 0]
        if len(again):
            self.young.add(hashes[again], raw, starts[again], size[again], *self.old.take(place[place >= 0]))
        if len(new):
            self.young.add(hashes[new], raw, starts[new], size[new], *self.encode([data[a:b].decode() for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]))
        place = np.full(len(hashes), -1)
        place[fit] = self.young.find(hashes[fit], lanes, starts[fit], size[fit])
        if (place >= 0).all():
            return self.young.take(place)
        odd = np.flatnonzero(place < 0)
        counts, ids = self.encode([data[a:b].decode() for a, b in zip(starts[odd].tolist(), stops[odd].tolist(), strict=True)])
        count, first = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        on = np.flatnonzero(place >= 0)
        count[on], first[on] = self.young.count[place[on]], self.young.first[place[on]]
        count[odd], first[odd] = counts, np.cumsum(counts) - counts + len(self.young.ids)
        return count, np.concatenate([self.young.ids, ids])[spread(first, count)]

    def pack(self, raw: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each text, and the end id, from the bytes of all texts and their offsets."""
        starts, stops, at = word_spans(raw, ends)
        hashes, first, which = distinct_words(raw, starts, stops)
        size, flat = self._ids(raw, hashes, starts[first], stops[first])
        n = size[which]
        laid = flat[spread((np.cumsum(size) - size)[which], n)]
        cut = np.concatenate([[0], np.cumsum(n)])[at].tolist()
        return [laid[a:b].tobytes() + END for a, b in zip(cut, cut[1:], strict=False)]


#: One coder for each vocabulary and worker; it serves all tasks that the worker runs, and its words are bounded in bytes.
_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def packed(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Blocks of a stream of batches with ``text``, and each text's packed ids with the end id."""
    own = coder(path)
    for block in blocks(batches, most=BLOCK_BYTES):
        yield block, own.pack(*text_bytes(block.column(block.schema.get_field_index("text"))))
    give_back()

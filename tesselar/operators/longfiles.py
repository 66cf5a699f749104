"""Splitting of files of any length: header and size splits of a file that many tasks read.

A file is dealt out as byte ranges, each moved to line borders (``blocks``). Whether a
line is a header depends on the fence it stands in, and a section's titles on the
headers before it. A first pass sums up what a block does to either, for each fence it
may begin in; a scan over these small rows gives every block the state it begins in; a
second pass reads the blocks again and cuts them. Sections inside a block leave its
task as pieces. Those that go on in other blocks are sent on as fragments and cut by
``Cutter``, which holds some pieces' text and not the section. The result is that of
``by_headers`` and ``by_size`` over the whole text. Memory is bounded by a range, a line
and a run of white space.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splitting import HEADER, SEPARATORS, by_size

RANGE = 8 << 20
#: Bytes read at a time when a line's end is looked for.
READ = 1 << 16
FENCES = ("", "```", "~~~")
KEEP = False  # a title that a block leaves as it was
#: Code points above which a section is split by size, as for files in one row.
SPLIT_ABOVE = 1500


def blocks(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, abs_path, block, start, stop, last): ranges of files (path, abs_path, size)."""
    n = F.greatest(F.ceil(F.col("size") / size), F.lit(1))
    ranges = files.select("path", "abs_path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("block"), (n - 1).alias("_n"))
    return ranges.select("path", "abs_path", "block", (F.col("block") * size).alias("start"), F.least((F.col("block") + 1) * size, F.col("size")).alias("stop"), (F.col("block") == F.col("_n")).alias("last"))


def _line_end(f, at: int) -> int:
    """The place after the first line end at or after a place, or the file's end."""
    f.seek(at)
    while part := f.read(READ):
        found = part.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(part)
    return at


def lines_of(path: str, start: int, stop: int, last: bool) -> list[str]:
    """The lines that begin in a range; the last range has the one after the last line end, too."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        first = 0 if start == 0 else _line_end(f, start - 1)
        end = size if last else _line_end(f, stop - 1)
        if first >= end:  # only an empty line after the file's last line end can begin there
            f.seek(max(size - 1, 0))
            return [""] if last and f.read(1) in (b"", b"\n") else []
        f.seek(first)
        text = f.read(end - first).decode("utf-8", "replace")
    return text[:-1].split("\n") if text.endswith("\n") and not last else text.split("\n")


def walk(lines: list[str], fence: str, titles: list) -> Iterator[tuple[list, list[str]]]:
    """(titles, lines) of the stretches between headers; the fence at the end is the generator's value."""
    held: list[str] = []
    for line in lines:
        mark = line.strip()[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in FENCES[1:]:
            fence = mark
        elif m := HEADER.match(line):
            yield titles, held
            depth = len(m[1])
            titles, held = [*titles[: depth - 1], m[2], *[None] * (3 - depth)], []
            continue
        held.append(line)
    yield titles, held
    return fence


def effect(lines: list[str]) -> str:
    """What a block does to the state, for each fence it may begin in: the fence after it, its titles and its headers, as JSON."""
    out = {}
    for fence in FENCES:
        if fence and not any(fence in line for line in lines):  # never closed, so nothing here is a header
            out[fence] = (fence, [KEEP] * 3, 0)
            continue
        run, n, titles = walk(lines, fence, [KEEP] * 3), -1, None
        while True:
            try:
                titles, n = next(run)[0], n + 1
            except StopIteration as end:
                out[fence] = (end.value, titles, n)
                break
    return json.dumps(out)


class _Parts:
    """Atoms of a stream of text at one separator: whole parts that fit, or those of the next separator."""

    def __init__(self, size: int, level: int, out):
        self.size, self.mark, self.out, self.level = size, SEPARATORS[level], out, level
        self.held, self.below = "", None

    def feed(self, text: str) -> None:
        if not self.mark:
            self.held += text
            whole = len(self.held) // self.size * self.size
            for i in range(0, whole, self.size):
                self.out(self.held[i : i + self.size])
            self.held = self.held[whole:]
            return
        self.held += text
        begin = 0 if self.below or not self.held.startswith(self.mark) or not self.started else len(self.mark)
        while (at := self.held.find(self.mark, begin)) >= 0:
            self._part(self.held[:at], True)
            self.held, begin, self.started = self.held[at:], len(self.mark), True
        if self.below or len(self.held) > self.size + len(self.mark):
            keep = len(self.mark) - 1  # a separator may begin here
            self._part(self.held[: len(self.held) - keep], False)
            self.held = self.held[len(self.held) - keep :]

    started = False  # whether what is held begins with the separator in front of its part

    def _part(self, text: str, ends: bool) -> None:
        if self.below is None and ends and len(text) <= self.size:
            self.out(text)
            return
        if self.below is None:
            self.below = _Parts(self.size, self.level + 1, self.out)
        self.below.feed(text)
        if ends:
            self.below.end()
            self.below = None

    def end(self) -> None:
        if self.mark:
            self._part(self.held, True)
        elif self.held:
            self.out(self.held)
        self.held = ""


class Cutter:
    """Pieces of one section whose text comes bit by bit: (content, number), the number null for a section that is not split."""

    def __init__(self, size: int, overlap: int):
        if not 0 <= overlap < size:
            raise ValueError("overlap must be at least 0 and below size")
        self.size, self.overlap = size, overlap
        self.space, self.begun, self.short = "", False, ""
        self.parts: _Parts | None = None
        self.held: list[str] = []
        self.n = self.fresh = self.number = 0
        self.found: list[tuple[str, int | None]] = []

    def feed(self, text: str) -> None:
        """White space at both ends is no content: what trails waits for what follows."""
        if not self.begun:
            text = text.lstrip()
            self.begun = bool(text)
        body = text.rstrip()
        if body:
            self._text(self.space + body)
            self.space = text[len(body) :]
        elif self.begun:
            self.space += text

    def _text(self, text: str) -> None:
        if self.parts is None:
            self.short += text
            if len(self.short) <= SPLIT_ABOVE:
                return
            text, self.parts = self.short, _Parts(self.size, 0, self._atom)
        self.parts.feed(text)

    def _atom(self, atom: str) -> None:
        if self.n + len(atom) > self.size:
            self._piece()
            while self.held and (self.n > self.overlap or self.n + len(atom) > self.size):
                self.n -= len(self.held.pop(0))
            self.fresh = 0
        self.held.append(atom)
        self.n += len(atom)
        self.fresh += 1

    def _piece(self) -> None:
        if self.fresh and (content := "".join(self.held).strip()):
            self.found.append((content, self.number))
            self.number += 1

    def take(self) -> list[tuple[str, int | None]]:
        found, self.found = self.found, []
        return found

    def end(self) -> list[tuple[str, int | None]]:
        if self.parts is None:
            return [(self.short, None)] if self.short else []
        self.parts.end()
        self._piece()
        return self.take()


KINDS = [("path", pa.string()), ("section", pa.int64()), ("h1", pa.string()), ("h2", pa.string()), ("h3", pa.string()), ("sub_chunk", pa.int32()), ("content", pa.string())]
PIECES = "path string, section bigint, h1 string, h2 string, h3 string, sub_chunk int, content string"


def long_pieces(files: DataFrame, size: int, overlap: int, span: int = RANGE) -> DataFrame:
    """(path, section, h1, h2, h3, sub_chunk, content) of files (path, abs_path, size): pieces of sections, numbered from 0 where a section is split.

    Sections are numbered in the order of the text; empty ones have no piece. Paths must be distinct.
    """
    dealt = blocks(files, span)
    names = ["path", "abs_path", "block", "start", "stop", "last"]

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([effect(lines_of(r["abs_path"], r["start"], r["stop"], r["last"])) for r in rows], pa.string())], names=["path", "block", "effect"])

    def scan(group: pa.Table) -> pa.Table:
        out, fence, titles, section = [], "", [None] * 3, 0
        for r in group.sort_by("block").to_pylist():
            out.append((r["path"], r["block"], fence, json.dumps(titles), section))
            fence, new, n = json.loads(r["effect"])[fence]
            titles, section = [old if t is KEEP else t for old, t in zip(titles, new, strict=True)], section + n
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "block", "fence", "titles", "section"])

    effects = dealt.select(names).repartition("path", "block").mapInArrow(sum_up, "path string, block bigint, effect string")
    states = effects.groupBy("path").applyInArrow(scan, "path string, block bigint, fence string, titles string, section bigint")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections that begin and end inside a block."""
        for r, parts in walked(batches):
            rows = []
            for i, (titles, held) in enumerate(parts):
                if inside(r, i, len(parts)) and (text := "\n".join(held).strip()):
                    cuts = enumerate(by_size(text, size, overlap)) if len(text) > SPLIT_ABOVE else [(None, text)]
                    rows += [(r["path"], r["section"] + i, *titles, number, content) for number, content in cuts]
            if rows:
                yield batch_of(rows, KINDS)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a block has of sections that go on in others."""
        for r, parts in walked(batches):
            rows = [(r["path"], r["section"] + i, *titles, None, "\n".join(held), r["block"], len(held)) for i, (titles, held) in enumerate(parts) if not inside(r, i, len(parts))]
            if rows:
                yield batch_of(rows, [*KINDS, ("block", pa.int64()), ("lines", pa.int64())])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list]]:
        for batch in batches:
            for r in batch.to_pylist():
                yield r, list(walk(lines_of(r["abs_path"], r["start"], r["stop"], r["last"]), r["fence"], json.loads(r["titles"])))

    def inside(r: dict, i: int, n: int) -> bool:
        return (i > 0 or r["block"] == 0) and (i < n - 1 or r["last"])

    def batch_of(rows: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    known = dealt.join(states, ["path", "block"])

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, begun = None, None, False

        def rows(found: list[tuple[str, int | None]]) -> Iterator[pa.RecordBatch]:
            if found:
                columns = [[x] * len(found) for x in now] + [[n for _, n in found], [c for c, _ in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, KINDS, strict=True)], names=[n for n, _ in KINDS])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["path"], r["section"], r["h1"], r["h2"], r["h3"])
                if now is None or key[:2] != now[:2]:
                    if cutter:
                        yield from rows(cutter.end())
                    now, cutter, begun = key, Cutter(size, overlap), False
                if r["lines"]:
                    cutter.feed(("\n" if begun else "") + r["content"])
                    begun = True
                    yield from rows(cutter.take())
        if cutter:
            yield from rows(cutter.end())

    over = known.mapInArrow(edges, f"{PIECES}, block bigint, lines bigint").repartition("path", "section").sortWithinPartitions("path", "section", "block")
    return known.mapInArrow(pieces, PIECES).unionByName(over.mapInArrow(mend, PIECES))

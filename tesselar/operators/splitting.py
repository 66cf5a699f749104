"""Text splitting: markdown headers, then sizes. Plain functions, run in Arrow batches.

Contract of ``by_headers``: lines starting with one to three ``#`` and a space
open a section, deeper levels reset, lines inside ``` or ~~~ fences are never
headers, header lines are not content, empty sections are skipped.
Contract of ``by_size``: pieces of at most ``size`` code points cut at the coarsest
of blank line, line, space, code point that will do; neighbouring pieces share at
most ``overlap`` code points; nothing but outer white space is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

HEADER = re.compile(r"(#{1,3})[ \t]+(.*?)[ \t]*#*[ \t]*$")
SEPARATORS = ("\n\n", "\n", " ", "")


class Section(NamedTuple):
    h1: str | None
    h2: str | None
    h3: str | None
    content: str


def by_headers(text: str) -> Iterator[Section]:
    levels: list[str | None] = [None, None, None]
    lines: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = line.strip()[:3]
        if fence:
            fence = "" if mark == fence else fence
        elif mark in ("```", "~~~"):
            fence = mark
        elif m := HEADER.match(line):
            if content := "\n".join(lines).strip():
                yield Section(*levels, content)
            lines = []
            depth = len(m[1])
            levels[depth - 1 :] = [m[2], *[None] * (3 - depth)]
            continue
        lines.append(line)
    if content := "\n".join(lines).strip():
        yield Section(*levels, content)


def _atoms(text: str, size: int, level: int) -> Iterator[str]:
    """Parts of at most ``size``, separators kept in front of what follows them."""
    if len(text) <= size:
        yield text
        return
    mark = SEPARATORS[level]
    if not mark:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    for i, part in enumerate(text.split(mark)):
        yield from _atoms(mark + part if i else part, size, level + 1)


def by_size(text: str, size: int, overlap: int) -> list[str]:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    out: list[str] = []
    held: list[str] = []
    n = fresh = 0
    for atom in _atoms(text, size, 0):
        if n + len(atom) > size:
            if fresh:
                out.append("".join(held).strip())
            while held and (n > overlap or n + len(atom) > size):
                n -= len(held.pop(0))
            fresh = 0
        held.append(atom)
        n += len(atom)
        fresh += 1
    if fresh:
        out.append("".join(held).strip())
    return [x for x in out if x]

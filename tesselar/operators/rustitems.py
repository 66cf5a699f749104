"""Items of Rust sources: a tokenizer, and a recursive descent over items only.

Bodies are walked for the items in them, so modules, impl blocks and functions may
nest; what is no item is skipped, bracket by bracket. Macro arguments hold no items.
A source that ends inside an item ends it; a closing bracket that nothing opened is
passed over.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*)|(?P<block>/\*)|(?P<raw>(?:br|cr|r)(?P<marks>\#*)\")|(?P<text>[bc]?\"(?:\\.|[^\"\\])*(?:\"|\Z))|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])')|(?P<life>'\w+)"
    r"|(?P<word>(?:r\#)?[^\W\d]\w*)|(?P<number>\d\w*)|(?P<mark>->|=>|::|[^\w\s])",
    re.S,
)
BLOCK = re.compile(r"/\*|\*/")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
BEFORE = frozenset("async unsafe extern default const gen safe".split())


@dataclass(frozen=True)
class Item:
    kind: str
    start: int
    end: int
    name: str
    head: str = ""  # parameters and result of a function, type of a constant, what an impl block is for
    value: str = ""
    visibility: str = ""


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) without comments; texts and characters are the token '"'."""
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        kind, end = m.lastgroup if m.lastgroup != "marks" else "raw", m.end()
        if kind == "block":
            depth = 1
            while depth and (b := BLOCK.search(text, end)):
                depth, end = depth + (1 if b[0] == "/*" else -1), b.end()
            end = end if not depth else len(text)
        elif kind == "raw":
            close = text.find('"' + m["marks"], end)
            end = len(text) if close < 0 else close + 1 + len(m["marks"])
            out.append(('"', at, end))
        elif kind in ("text", "char"):
            out.append(('"', at, end))
        elif kind != "space":
            out.append((m[0], at, end))
        at = end
    return out


class Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at, self.items = text, tokens(text), 0, []

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def place(self) -> int:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else len(self.text)

    def done(self) -> int:
        """The end of the last token that was read."""
        return self.tokens[min(self.at, len(self.tokens)) - 1][2] if self.at else 0

    def name(self) -> bool:
        return bool(re.match(r"(?:r#)?[^\W\d]", self.peek()))

    def skip(self, opening: str, closing: str) -> None:
        """Over a balanced pair, other brackets inside included; generics that do not close end where they cannot go on."""
        open_ = [closing]
        self.at += 1
        while open_ and self.peek():
            token = self.peek()
            if token == open_[-1]:
                open_.pop()
            elif token in OPEN:
                open_.append(OPEN[token])
            elif open_[-1] == ">" and token == "<":
                open_.append(">")
            elif open_[-1] == ">" and (token == ";" or token in CLOSE):
                while open_ and open_[-1] == ">":
                    open_.pop()
                continue
            self.at += 1

    def until(self, *ends: str) -> int:
        """To one of the tokens outside brackets and generics; the end of what was passed."""
        while self.peek() and self.peek() not in ends and self.peek() not in CLOSE:
            if self.peek() == "<" and ("{" in ends or "=" in ends):
                self.skip("<", ">")
            elif self.peek() in OPEN:
                self.skip(self.peek(), OPEN[self.peek()])
            else:
                self.at += 1
        return self.done()

    def body(self) -> None:
        """A block in braces, with its items; nothing if there is none."""
        if self.peek() == "{":
            self.at += 1
            self.block()
            self.at += self.peek() == "}"

    def block(self) -> None:
        """Items up to the brace that closes the block, or the end."""
        while self.peek() and self.peek() != "}":
            before = self.at
            self.item()
            if self.at == before:
                self.other()

    def other(self) -> None:
        """Over what is no item."""
        if self.peek() == "{":
            self.body()
        elif self.peek() == "!" and self.peek(1) in OPEN or self.peek() == "!" and self.peek(2) in OPEN:
            self.at += 1 if self.peek(1) in OPEN else 2
            self.skip(self.peek(), OPEN[self.peek()])
        elif self.peek() in ("(", "["):  # a closure's body in arguments may hold items
            closing = OPEN[self.peek()]
            self.at += 1
            while self.peek() and self.peek() != closing and self.peek() != "}":
                self.other()
            self.at += self.peek() == closing
        else:
            self.at += 1

    def item(self) -> None:
        """An item that starts here is read and kept; else nothing is read."""
        back = self.at
        while self.peek() == "#" and self.peek(1) in ("[", "!"):
            self.at += 1 + (self.peek(1) == "!")
            if self.peek() != "[":
                self.at = back
                return
            self.skip("[", "]")
        start, seen = self.place(), ""
        if self.peek() == "pub":
            self.at += 1
            if self.peek() == "(":
                self.skip("(", ")")
            seen = self.text[start : self.done()]
        while self.peek() in BEFORE and not (self.peek() == "const" and self.peek(1) not in (*BEFORE, "fn")):
            self.at += 1
            self.at += self.peek() == '"'
        read = {"fn": self.function, "struct": self.type, "enum": self.type, "union": self.type, "const": self.constant, "impl": self.implementation, "mod": self.scope, "trait": self.scope}.get(self.peek())
        kind, here = self.peek(), len(self.items)
        self.at += 1
        found = read(kind) if read else None
        if found is None:
            self.at = back if not read else self.at
            return
        if found:
            self.items.insert(here, Item(start=start, end=self.done(), visibility=seen, **found))

    def function(self, _: str) -> dict | None:
        if not self.name():
            return {}
        name = self.peek()
        self.at += 1
        if self.peek() == "<":
            self.skip("<", ">")
        first = self.place()
        if self.peek() != "(":
            return {}
        self.skip("(", ")")
        last = self.done()
        if self.peek() == "->":
            last = self.until("{", ";", "where")
        head = self.text[first:last]
        self.until("{", ";")
        if self.peek() != "{":  # a declaration in a trait
            self.at += self.peek() == ";"
            return {}
        self.body()
        return {"kind": "function", "name": name, "head": head}

    def type(self, kind: str) -> dict | None:
        if not self.name() or self.peek(1) not in ("<", "{", "(", ";", "where", ""):
            return {}
        name = self.peek()
        self.at += 1
        self.until("{", ";")
        if self.peek() == "{":
            self.skip("{", "}")
        else:
            self.at += self.peek() == ";"
        return {"kind": kind, "name": name}

    def constant(self, _: str) -> dict | None:
        name = self.peek()
        if self.peek(1) != ":":
            return {}
        self.at += 2
        first = self.place()
        kind = self.text[first : self.until("=", ";")].strip()
        value = ""
        if self.peek() == "=":
            self.at += 1
            first = self.place()
            value = self.text[first : self.until(";")].strip()
        self.at += self.peek() == ";"
        return {"kind": "const", "name": name, "head": kind, "value": value}

    def implementation(self, _: str) -> dict | None:
        first = self.place()
        if self.peek() == "<":
            self.skip("<", ">")
        head = self.text[first : self.until("{", ";")]
        if self.peek() != "{":
            return {}
        self.body()
        return {"kind": "impl", "name": "", "head": head.strip()}

    def scope(self, _: str) -> dict | None:
        if not self.name():
            return {}
        self.until("{", ";")
        self.body()
        self.at += self.peek() == ";"
        return {}


def items(text: str) -> list[Item]:
    """All functions with a body, structs, enums, constants and impl blocks, in the order in which they start."""
    reader, limit = Reader(text), sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * len(reader.tokens) + 1000))  # blocks may nest as deeply as the source does
    try:
        while reader.peek():
            reader.block()
            reader.at += 1  # a brace that nothing opened
    finally:
        sys.setrecursionlimit(limit)
    return sorted(reader.items, key=lambda x: x.start)

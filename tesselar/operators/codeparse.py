"""Rust, Go and Java sources to items and constants, by rules.

A rule names a kind, a pattern whose groups fill templates, and how the body ends.
Bodies end where braces balance; ``aware`` skips braces in strings and comments.
Rust's tree rules have a grammar of their own (``rustitems``).
Items and constants of a file keep the order of the rules, then of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from .rustitems import items as rust_items


class Found(NamedTuple):
    row_type: str
    kind: str
    name: str
    signature: str
    body: str
    value: str | None
    type_annotation: str | None
    doc_comment: str | None
    line_number: int
    visibility: str
    attributes: list[str]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    signature: Callable[[re.Match], str] = lambda m: ""
    body: str = "braces"  # braces: from an opened one; next: from the next one; either: braces or ';'; none
    public: bool = True  # needs a visibility that starts with pub
    shown: str | None = None  # visibility, if the pattern has none


# What counts as an item in each language.
RUST_FN = re.compile(r"^(?P<lead>\s*)(?P<vis>pub(?:\([^)]+\))?\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]+>)?\s*\((?P<params>[^)]*)\)(?P<ret>\s*->\s*[^{]+)?\s*\{", re.M)
RUST_ASYNC_FN = re.compile(r"^(?P<lead>\s*)(?P<vis>pub(?:\([^)]+\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)\s*(?:<[^>]+>)?\s*\((?P<params>[^)]*)\)(?P<ret>\s*->\s*[^{]+)?\s*\{", re.M)
RUST_STRUCT = re.compile(r"^(?P<lead>\s*)(?P<vis>pub(?:\([^)]+\))?\s+)?struct\s+(?P<name>\w+)", re.M)
RUST_ENUM = re.compile(r"^(?P<lead>\s*)(?P<vis>pub(?:\([^)]+\))?\s+)?enum\s+(?P<name>\w+)", re.M)
RUST_CONST = re.compile(r"^(?P<lead>\s*)(?P<vis>pub(?:\([^)]+\))?\s+)?const\s+(?P<name>\w+)\s*:\s*(?P<type>[^=]+)\s*=\s*(?P<value>[^;]+);", re.M)
GO_FUNC = re.compile(r"^func\s+(?:\([^)]+\)\s+)?(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\)\s*(?P<ret>[^{]*)\{", re.M)
GO_STRUCT = re.compile(r"^type\s+(?P<name>[A-Z]\w*)\s+struct\s*\{", re.M)
GO_INTERFACE = re.compile(r"^type\s+(?P<name>[A-Z]\w*)\s+interface\s*\{", re.M)
GO_CONST = re.compile(r"\s*(?P<name>[A-Z]\w*)\s*=\s*(?P<value>.+)$")
JAVA_METHOD = re.compile(r"^(?P<lead>\s*)public\s+(?:static\s+)?(?:<[^>]+>\s+)?(?P<type>\w+(?:<[^>]+>)?)\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)", re.M)
JAVA_CLASS = re.compile(r"^(?P<lead>\s*)public\s+(?:final\s+)?class\s+(?P<name>\w+)", re.M)
JAVA_CONST = re.compile(r"^(?P<lead>\s*)public\s+static\s+final\s+(?P<type>\w+)\s+(?P<name>\w+)\s*=\s*(?P<value>.+);", re.M)


def _rust_signature(m: re.Match) -> str:
    return f"fn {m['name']}({m['params'] or ''}){m['ret'] or ''}".strip()


_STRUCT = Rule("struct", RUST_STRUCT, lambda m: f"struct {m['name']}", "either")
_ENUM = Rule("enum", RUST_ENUM, lambda m: f"enum {m['name']}", "either")
RULES: dict[str, list[Rule]] = {
    "rust_spec": [Rule("function", RUST_FN, _rust_signature), _STRUCT, _ENUM, Rule("const", RUST_CONST, body="none")],
    "rust": [Rule("function", RUST_ASYNC_FN, _rust_signature), _STRUCT, Rule("const", RUST_CONST, body="none", public=False)],
    "rust_tree": [],  # by its own grammar
    "go": [
        Rule("function", GO_FUNC, lambda m: f"func {m['name']}({m['params']}) {m['ret'].strip()}".strip(), shown="pub"),
        Rule("struct", GO_STRUCT, lambda m: f"type {m['name']} struct", shown="pub"),
        Rule("interface", GO_INTERFACE, lambda m: f"type {m['name']} interface", shown="pub"),
    ],
    "java": [
        Rule("function", JAVA_METHOD, lambda m: f"public {m['type']} {m['name']}({m['params']})", "next", shown="pub"),
        Rule("struct", JAVA_CLASS, lambda m: f"class {m['name']}", "none", shown="pub"),
        Rule("const", JAVA_CONST, body="none", shown="pub"),
    ],
}
LANGUAGES = frozenset(RULES)

_SKIP = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|`[^`]*`|'(?:\\.|[^'\\])'", re.S)
_BRACE = re.compile(r"[{}]")
_BRACE_OR_END = re.compile(r"[{};]")


def blanked(text: str) -> str:
    """The text with strings and comments blanked, every place kept."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_end(text: str, at: int, depth: int) -> int:
    """The place after the brace that brings ``depth`` to 0; the end of the text if there is none."""
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _end(rule: Rule, text: str, m: re.Match) -> int:
    if rule.body == "braces":
        return body_end(text, m.end(), 1)
    if rule.body == "next":
        at = text.find("{", m.end())
        return len(text) if at < 0 else body_end(text, at + 1, 1)
    first = _BRACE_OR_END.search(text, m.end())
    if not first:
        return len(text)
    return body_end(text, first.end(), 1) if first[0] == "{" else first.end()


def doc_above(lines: list[str], at: int, language: str) -> str | None:
    """Documentation that ends above a line; blank lines (and attributes in Rust) are passed over."""
    found: list[str] = []
    for line in map(str.strip, reversed(lines[:at])):
        if language == "java":
            if line.startswith("/**") and not (line.endswith("*/") and len(line) > 4):
                break
            if line.startswith("/**"):
                found.append(line[3:-2].strip())
                break
            if line.startswith("*/") or not line:
                continue
            if line.startswith("*"):
                found.append(line.lstrip("* ").strip())
            elif line.endswith("*/"):
                found.append(line.rstrip("*/").strip())
            else:
                break
        elif language == "go":
            if line.startswith("//"):
                found.append(line[2:].strip())
            elif line:
                break
        elif line.startswith(("///", "//!")):
            found.append(line[3:].strip())
        elif line and not line.startswith("#["):
            break
    return "\n".join(reversed(found)) if found else None


def attributes_above(lines: list[str], at: int) -> list[str]:
    """``#[...]`` lines above a line; docs and blank lines are passed over."""
    found: list[str] = []
    for line in map(str.strip, reversed(lines[:at])):
        if line.startswith("#["):
            found.append(line)
        elif line and not line.startswith(("///", "//!")):
            break
    return found[::-1]


def _go_constants(lines: list[str]) -> list[Found]:
    """Exported names with a value: in ``const (`` blocks and on ``const`` lines."""
    found, inside = [], False
    for i, raw in enumerate(lines):
        line = raw.strip()
        if line.startswith("const ("):
            inside = True
        elif inside and line == ")":
            inside = False
        elif (inside or line.startswith("const ")) and (m := GO_CONST.match(line.replace("const ", ""))):
            found.append(Found("constant", "const", m["name"], "", "", m["value"].strip(), None, doc_above(lines, i, "go"), i + 1, "pub", []))
    return found


def rust_tree(text: str) -> list[Found]:
    """Items with a visibility that starts with pub, and impl blocks; then all constants."""
    lines, found, constants = text.split("\n"), [], []
    for x in rust_items(text):
        line = text.rfind("\n", 0, x.start) + 1
        start = line if not text[line : x.start].strip() else x.start
        row = text.count("\n", 0, x.start)
        doc, above = doc_above(lines, row, "rust"), attributes_above(lines, row)
        if x.kind == "const":
            constants.append(Found("constant", "const", x.name, "", "", x.value, x.head, doc, row + 1, x.visibility or "private", above))
        elif x.kind == "impl":
            head = " ".join(x.head.split())
            found.append(Found("item", "impl", re.sub(r"^<[^>]*>\s*", "", head), f"impl {head}", text[start : x.end], None, None, doc, row + 1, "private", above))
        elif x.visibility and x.kind in ("function", "struct", "enum"):
            signature = f"fn {x.name}{x.head}" if x.kind == "function" else f"{x.kind} {x.name}"
            found.append(Found("item", x.kind, x.name, signature, text[start : x.end], None, None, doc, row + 1, x.visibility, above))
    return found + constants


def parse(text: str, rules: str, aware: bool = False) -> list[Found]:
    """Items, then constants, of a source. ``line_number`` is that of the item itself, below blank lines that its pattern also takes."""
    if rules == "rust_tree":
        return rust_tree(text)
    lines, language = text.split("\n"), rules.split("_")[0]
    scanned = blanked(text) if aware else text
    items: list[tuple[int, Found]] = []
    constants: list[Found] = []
    for rule in RULES[rules]:
        for m in rule.pattern.finditer(scanned):
            given = m.groupdict()
            visibility = (given.get("vis") or "").strip()
            if rule.shown is None and rule.public and not visibility.startswith("pub"):
                continue
            lead = given.get("lead") or ""
            start = m.start() + (lead.rfind("\n") + 1)
            row = text.count("\n", 0, start)
            doc = doc_above(lines, row, language)
            if rule.kind == "const":
                lo, hi = m.span("value")
                kind = text[slice(*m.span("type"))].strip() if "type" in given else None
                constants.append(Found("constant", "const", m["name"], "", "", text[lo:hi].strip(), kind, doc, row + 1, visibility or "private", []))
                continue
            body = "" if rule.body == "none" else text[start : _end(rule, scanned, m)]
            items.append((start, Found("item", rule.kind, m["name"], rule.signature(m), body, None, None, doc, row + 1, rule.shown or visibility or "pub", [])))
    if rules == "go":
        constants = _go_constants(lines)
    return [x for _, x in items] + constants

"""Python sources to chunks: module text, classes, their methods, functions, constants."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from pathlib import PurePosixPath

CLASS_MOST, CLASS_KEPT = 3000, 2500
FUNCTION_MOST, FUNCTION_KEPT = 2000, 1800
MARK = "\n    # ... (truncated)"
DOC_MOST, VALUE_MOST = 500, 200


def constant_name(name: str) -> bool:
    return name.isupper()


class Source:
    """One parsed file; ``rows`` gives (section, chunk_type, content, metadata) in document order."""

    def __init__(self, text: str, path: str):
        self.lines, self.path, self.tree = text.split("\n"), PurePosixPath(path), ast.parse(text)

    def rows(self) -> Iterator[tuple[str, str, str, dict]]:
        if doc := ast.get_docstring(self.tree):
            yield self.path.stem, "lean_doc", doc, {"doc_type": "module", "file_name": self.path.name}
        for node in self.tree.body:
            match node:
                case ast.ClassDef():
                    yield self._class(node)
                    yield from (self._function(x, node.name) for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)))
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    yield self._function(node, "")
                case ast.Assign(targets=[ast.Name(id=name)]) if constant_name(name):
                    yield self._constant(node, name, {})
                case ast.AnnAssign(target=ast.Name(id=name)) if constant_name(name):
                    yield self._constant(node, name, {"type_annotation": ast.unparse(node.annotation)})

    def _text(self, node: ast.AST) -> str:
        """Lines of a node; decorators stand above its first line."""
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    @staticmethod
    def _cut(text: str, most: int, kept: int) -> str:
        return text if len(text) <= most else text[:kept] + MARK

    def _class(self, node: ast.ClassDef) -> tuple[str, str, str, dict]:
        bases = [ast.unparse(b) if isinstance(b, ast.Name) or isinstance(b.value, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        meta = {"class_name": node.name, "base_classes": ",".join(bases), "docstring": (ast.get_docstring(node) or "")[:DOC_MOST], "line_number": str(node.lineno)}
        return node.name, "lean_class", self._cut(self._text(node), CLASS_MOST, CLASS_KEPT), meta

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str) -> tuple[str, str, str, dict]:
        shown = ", ".join(a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args)
        returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        prefix = "async " if isinstance(node, ast.AsyncFunctionDef) else ""
        full = f"{owner}.{node.name}" if owner else node.name
        meta = {"function_name": node.name, "full_name": full, "signature": f"{prefix}def {node.name}({shown}){returns}:", "docstring": (ast.get_docstring(node) or "")[:DOC_MOST], "line_number": str(node.lineno), "is_method": str(bool(owner)).lower(), "class_name": owner}
        return full, "lean_function", self._cut(self._text(node), FUNCTION_MOST, FUNCTION_KEPT), meta

    def _constant(self, node: ast.Assign | ast.AnnAssign, name: str, more: dict) -> tuple[str, str, str, dict]:
        value = ast.unparse(node.value)[:VALUE_MOST] if node.value else ""
        return name, "lean_constant", self._text(node), {"constant_name": name, **more, "value": value, "line_number": str(node.lineno)}


def python_rows(text: str, path: str) -> list[tuple[str, str, str, dict]]:
    """Rows of a file; none if it cannot be parsed."""
    try:
        return list(Source(text, path).rows())
    except (SyntaxError, ValueError, RecursionError):
        return []

"""Python files, by the standard library's parser, or by their indentation where that fails."""

from __future__ import annotations

import ast
import re

from .result import Found, Lines, mask, pairs

_hidden = re.compile(r"""#[^\n]*|(?:\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_statement = re.compile(
    r"^(?P<indent>[^\S\n]*)(?:(?:async\s+)?def\s+(?P<function>\w+)|class\s+(?P<class>\w+)[^\S\n]*(?P<open>\()?|import\s+(?P<modules>[^\n;]+)|from\s+(?P<module>[.\w]+)\s+import\b)", re.M
)


def scan(text: str, file: str) -> Found:
    """Functions, methods, classes and their bases, imports.

    Special methods but __init__ are no symbols, though what their bodies define
    is. A file that doesn't parse, as of another version of the language or while
    it is written, gives what its lines declare.
    """
    try:
        return _parsed(ast.parse(text), text, file)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_lines(text, file)


def _special(name: str) -> bool:
    return name.startswith("__") and name.endswith("__") and name != "__init__"


def _by_lines(text: str, file: str) -> Found:
    """Declarations by the lines that begin with them; a deeper indent is inside the one before."""
    found, masked, lines = Found(file), mask(text, _hidden), Lines(text)
    closes = pairs(masked)
    inside = sorted((a, b) for a, b in closes.items())
    stack: list[tuple[int, str | None]] = []
    covered = 0
    for m in _statement.finditer(masked):
        while inside and inside[0][0] < m.start():
            covered = max(covered, inside.pop(0)[1])
        if m.start() < covered < len(masked):
            continue
        indent = len(m["indent"].expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        owner, line = stack[-1][1] if stack else None, lines.at(m.end("indent"))
        if name := m["function"]:
            if not _special(name):
                found.member(owner, name, line)
            stack.append((indent, owner if _special(name) else None))
        elif name := m["class"]:
            if m["open"]:
                for base in _arguments(masked, text, m.end() - 1, closes):
                    found.edge(found.id(name), found.id(base), "InheritsFrom")
            found.node(name, "Class", line)
            stack.append((indent, name))
        elif m["module"]:
            found.imports(m["module"])
        else:
            for part in m["modules"].split(","):
                found.imports(re.split(r"\s+as\s+", part.strip())[0].strip())
    return found


def _arguments(masked: str, text: str, at: int, closes: dict[int, int]) -> list[str]:
    """What commas part between a bracket and its end."""
    end, begin, out = closes.get(at, len(masked)), at + 1, []
    i = begin
    while i <= end:
        if i == end or masked[i] == ",":
            out.append(text[begin:i].strip())
            begin = i + 1
        i = closes.get(i, i) + 1 if i < end and masked[i] in "([{" else i + 1
    return [x for x in out if x]


def _parsed(tree: ast.AST, text: str, file: str) -> Found:
    found = Found(file)

    def walk(node: ast.AST, owner: str | None) -> None:
        if isinstance(node, ast.Import):
            for name in node.names:
                found.imports(name.name)
        elif isinstance(node, ast.ImportFrom):
            found.imports("." * node.level + (node.module or ""))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            special = _special(node.name)
            if not special:
                found.member(owner, node.name, node.lineno)
            for child in node.body:
                walk(child, owner if special else None)
        elif isinstance(node, ast.ClassDef):
            for base in [*node.bases, *node.keywords]:
                found.edge(found.id(node.name), found.id(ast.get_source_segment(text, base) or ast.unparse(base)), "InheritsFrom")
            found.node(node.name, "Class", node.lineno)
            for child in node.body:
                walk(child, node.name)
        else:
            for child in ast.iter_child_nodes(node):
                walk(child, owner)

    walk(tree, None)
    return found

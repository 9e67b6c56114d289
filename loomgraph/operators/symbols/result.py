"""What a scanner finds in one file, and text helpers that scanners share."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

EXTRACTED = ("Extracted", 1.0)


def inferred(score: float) -> tuple[str, float]:
    return "Inferred", score


@dataclass
class Found:
    """nodes: id, label, type, line. edges: from, to, kind, confidence class, score."""

    file: str
    nodes: list[tuple[str, str, str, int]] = field(default_factory=list)
    edges: list[tuple[str, str, str, str, float]] = field(default_factory=list)

    def id(self, name: str) -> str:
        return f"{self.file}::{name}"

    def node(self, name: str, kind: str, line: int, label: str | None = None) -> str:
        self.nodes.append((self.id(name), label or name, kind, line))
        return self.id(name)

    def edge(self, from_id: str, to_id: str, kind: str, confidence: tuple[str, float] = EXTRACTED) -> None:
        self.edges.append((from_id, to_id, kind, *confidence))

    def member(self, owner: str | None, name: str, line: int, label: str | None = None) -> str:
        """A function, or a method that its owner contains."""
        made = self.node(name, "Method" if owner else "Function", line, label)
        if owner:
            self.edge(self.id(owner), made, "Contains")
        return made

    def imports(self, module: str) -> None:
        if module:
            self.edge(self.id("__module__"), f"{module}::__module__", "Imports")

    def merge(self, other: Found) -> None:
        self.nodes += other.nodes
        self.edges += other.edges

    def is_empty(self) -> bool:
        return not self.nodes and not self.edges


def mask(text: str, hidden: re.Pattern) -> str:
    """text with comments and strings blanked, at the same length and with the same lines."""
    return hidden.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def pairs(masked: str) -> dict[int, int]:
    """Where each opening bracket closes; one that doesn't, at the end."""
    closes, stack = {}, []
    for m in re.finditer(r"[(\[{}\])]", masked):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
    return closes | {at: len(masked) for at in stack}


class Lines:
    """Line numbers from 1 of places in a text."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, place: int) -> int:
        return bisect_right(self.starts, place)

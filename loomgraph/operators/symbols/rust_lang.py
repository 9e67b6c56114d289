"""Rust files, by a scan of items and their braces."""

from __future__ import annotations

import re

from .result import Found, Lines, inferred, mask, pairs

_hidden = re.compile(r"""//[^\n]*|/\*.*?\*/|\bb?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\])'""", re.S)
_item = re.compile(r"\b(?:fn\s+(?P<fn>\w+)|struct\s+(?P<struct>\w+)|(?P<impl>impl)\b|mod\s+(?P<mod>\w+)|(?P<use>use)\s)")
_call = re.compile(r"(?<![\w.!])((?:\w+\s*::\s*)*\w+)\s*\(")
_macro = re.compile(r"\b\w+!\s*(?=[(\[{])")
#: Words before a parenthesis that are no call.
KEYWORDS = {"if", "while", "match", "for", "in", "return", "fn", "let", "loop", "else", "move", "as", "where", "unsafe", "async", "await", "break"}


def _angles(text: str) -> str:
    """text without the generics that it begins with."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">" and text[i - 1 : i] != "-")
        if c == ">" and not depth:
            return text[i + 1 :]
    return text


class _Scan:
    def __init__(self, text: str, file: str) -> None:
        self.text, self.found, self.lines = text, Found(file), Lines(text)
        self.masked = mask(text, _hidden)
        self.closes = pairs(self.masked)

    def head_end(self, at: int, end: int) -> int:
        """Where a signature ends: its body's brace, or its semicolon."""
        while at < end:
            c = self.masked[at]
            if c in "{;":
                return at
            at = self.closes.get(at, at) + 1 if c in "([" else at + 1
        return end

    def items(self, at: int, end: int, owner: str | None) -> None:
        while m := _item.search(self.masked, at, end):
            at = m.end()
            if m["use"]:
                at = self.masked.find(";", at, end) % (end + 1)
                path = self.text[m.end() : at].strip()
                if path.startswith(("crate::", "super::", "self::")):
                    self.found.edge(self.found.id("__module__"), self.found.id(path), "Imports")
            elif m["struct"]:
                self.found.node(m["struct"], "Struct", self.lines.at(m.start()))
            else:
                head = self.head_end(at, end)
                body = self.masked[head : head + 1] == "{"
                close = min(self.closes.get(head, end), end) if body else head
                if m["fn"] and body:
                    made = self.found.member(owner, m["fn"], self.lines.at(m.start()))
                    self.calls(made, head + 1, close)
                elif m["mod"]:
                    self.found.node(m["mod"], "Module", self.lines.at(m.start()))
                    if body:
                        self.items(head + 1, close, None)
                elif m["impl"] and body:
                    self.implementation(self.text[at:head], head + 1, close)
                at = close + 1

    def implementation(self, head: str, at: int, end: int) -> None:
        head = head.strip()
        head = _angles(head).strip() if head.startswith("<") else head
        head = re.split(r"\bwhere\b", head)[0].strip()
        trait, has_trait, target = head.rpartition(" for ") if not re.search(r"\bfor\s*<", head) else re.split(r"(\sfor\s)(?!\s*<)", head, maxsplit=1) if re.search(r"\sfor\s(?!\s*<)", head) else ("", "", head)
        target, trait = target.strip(), trait.strip().lstrip("!")
        if target and has_trait and trait:
            self.found.edge(self.found.id(target), self.found.id(trait), "Implements", inferred(0.8))
        self.items(at, end, target or None)

    def calls(self, caller: str, at: int, end: int) -> None:
        body = self.masked[at:end]
        for m in reversed(list(_macro.finditer(body))):
            # what a macro is given isn't parsed as calls
            close = min(self.closes.get(at + m.end(), end), end) - at
            body = body[: m.end()] + re.sub(r"[^\n]", " ", body[m.end() : close]) + body[close:]
        for m in _call.finditer(body):
            leaf = m[1].split("::")[-1].strip()
            if leaf[:1].isalpha() and leaf not in KEYWORDS and not re.search(r"\bfn\s+$", body[: m.start()]):
                self.found.edge(caller, self.found.id(leaf), "Calls", inferred(0.7))


def scan(text: str, file: str) -> Found:
    """Functions and methods with what they call, structs, implementations, modules, uses inside the crate.

    Functions inside bodies are no symbols; traits give those of their methods that have a body.
    """
    one = _Scan(text, file)
    one.items(0, len(text), None)
    return one.found

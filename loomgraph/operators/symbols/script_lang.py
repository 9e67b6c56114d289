"""TypeScript and JavaScript files, by a scan of declarations and their braces."""

from __future__ import annotations

import re

from .result import Found, Lines, mask, pairs

_hidden = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_name = r"[A-Za-z_$][\w$]*"
_item = re.compile(
    rf"(?<![\w$.])(?:(?P<import>import)\b(?!\s*\()|(?P<function>function)\s*\*?\s*(?P<fname>{_name})?\s*(?=[(<])"
    rf"|(?P<class>class)\b\s*(?P<cname>(?!extends\b|implements\b){_name})?|(?P<decl>const|let|var)\s+(?P<vname>{_name})|(?P<arrow>=>))"
)
_method = re.compile(rf"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set|\*)\s+|\*\s*)*(?P<name>#?{_name})\s*(?:<[^(){{}}]*>)?\s*(?P<open>\()")
_value = re.compile(rf"\s*(?::[^=;]+?(?:=>[^=;]+?)?)?=(?!=|>)\s*(?P<value>(?:async\s+)?(?:function\b|<[^()]*>\s*\(|\(|{_name}\s*=>))")
#: Words before a parenthesis and a brace that are no method.
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "with", "new", "super", "await", "do", "else", "typeof"}


class _Scan:
    def __init__(self, text: str, file: str, typed: bool) -> None:
        self.text, self.typed, self.found, self.lines = text, typed, Found(file), Lines(text)
        self.masked = mask(text, _hidden)
        self.closes = pairs(self.masked)

    def body_of(self, at: int, end: int) -> int:
        """Behind the body that follows parameters at a place, or the place where none does."""
        at = self.masked.find("(", at, end)
        if at < 0:
            return end
        at = self.closes.get(at, end) + 1
        m = re.compile(r"\s*(?::[^{;=]+(?:\{[^{}]*\}[^{;=]*)?)?\s*(?:=>\s*)?").match(self.masked, at, end)
        at = m.end() if m else at
        return self.closes.get(at, end) + 1 if self.masked[at : at + 1] == "{" else at

    def items(self, at: int, end: int, owner: str | None) -> None:
        while m := _item.search(self.masked, at, end):
            at, line = m.end(), self.lines.at(m.start())
            if m["import"]:
                stop = re.compile(r"[;\n](?![^{}]*\})").search(self.masked, at, end)
                at = stop.start() if stop else end
                if source := re.search(r"""(?:\bfrom\s*|^\s*)["']([^"']+)["']""", self.text[m.end() : at]):
                    self.found.imports(source[1])
            elif m["function"]:
                if m["fname"] and (self.typed or self.declares(m.start())):
                    self.found.member(owner, m["fname"], line)
                at = self.body_of(at, end)
            elif m["class"]:
                at = self.class_body(m, at, end, line)
            elif m["decl"]:
                at = self.variable(m, at, end, line)
            elif m["arrow"]:
                brace = re.compile(r"\s*\{").match(self.masked, at, end)
                at = self.closes.get(brace.end() - 1, end) + 1 if brace else at

    def declares(self, at: int) -> bool:
        """Whether a function at a place is a statement rather than a value."""
        before = self.masked[:at].rstrip()
        before = re.sub(r"\basync$", "", before).rstrip()
        return not before or before[-1] in ";{}" or re.search(r"\b(?:export|default)$", before) is not None or "\n" in self.masked[len(before) : at] and before[-1] not in "=(,:?&|+["

    def class_body(self, m: re.Match, at: int, end: int, line: int) -> int:
        brace = self.masked.find("{", at, end)
        if brace < 0:
            return at
        close = min(self.closes.get(brace, end), end)
        if m["cname"]:
            self.found.node(m["cname"], "Class", line)
            self.members(m["cname"], brace + 1, close)
        return close + 1

    def members(self, owner: str, at: int, end: int) -> None:
        while at < end:
            c = self.masked[at]
            if m := _method.match(self.masked, at, end):
                after = self.body_of(m.start("open"), end)
                has_body = self.masked[after - 1 : after] == "}" and after - 1 > self.closes.get(m.start("open"), end)
                if has_body and m["name"] not in KEYWORDS:
                    self.found.member(owner, m["name"], self.lines.at(at))
                at = max(after, m.end())
            elif c in "{([":
                at = self.closes.get(at, end) + 1
            elif c.isalnum() or c in "_$#":
                # a field: its name, and what it is set to up to the end of the statement
                at = re.compile(r"[\w$#]+").match(self.masked, at, end).end()
            elif c == "=" and self.masked[at : at + 2] != "=>":
                at = self.statement_end(at + 1, end)
            else:
                at += 1

    def statement_end(self, at: int, end: int) -> int:
        while at < end and self.masked[at] not in ";\n":
            at = self.closes.get(at, at) + 1 if self.masked[at] in "{([" else at + 1
        return at

    def variable(self, m: re.Match, at: int, end: int, line: int) -> int:
        if self.typed and m["decl"] == "var":
            return at
        value = _value.match(self.masked, at, end)
        if not value:
            return self.statement_end(at, end)
        function = "function" in value["value"] or value["value"].endswith("=>")
        if not function:
            close = self.closes.get(value.end() - 1, end) + 1
            function = re.compile(r"\s*(?::[^={;]+)?\s*=>").match(self.masked, close, end) is not None
        name = m["vname"]
        if function and (not self.typed or name[:1].isupper()):
            self.found.node(name, "Function", line)
        return self.statement_end(at, end)


def scan_typed(text: str, file: str) -> Found:
    """Functions, classes, methods, imports, and constants with a capital that are functions.

    Bodies of functions, methods and arrows aren't looked into.
    """
    one = _Scan(text, file, True)
    one.items(0, len(text), None)
    return one.found


def scan_plain(text: str, file: str) -> Found:
    """As scan_typed, but variables of any name and kind that are functions, and no named function values."""
    one = _Scan(text, file, False)
    one.items(0, len(text), None)
    return one.found

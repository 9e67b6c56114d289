"""Whole scans of small trees, presentation, the registry, the server and the stream."""

import io
import json

import pytest

from loomgraph.config import ProjectConfig
from loomgraph.errors import InvalidRoot
from loomgraph.plans import present
from loomgraph.plans.project import Project, Registry
from loomgraph.plans.server import call, definitions, respond, serve
from loomgraph.sources.files import collect_files, project_name
from loomgraph.streaming.incremental import IncrementalTables, follow


def write(root, texts):
    for path, text in texts.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


AXUM = {
    "Cargo.toml": '[package]\nname = "test-service"\n', "src/main.rs": 'use axum::Router;\nfn build_router() { Router::new().route("/api/users", get(a)).route("/api/health", get(b)); }\nfn main() { std::env::var("DATABASE_URL"); build_router(); }\n',
    "src/models.rs": 'use sea_orm::entity::prelude::*;\n#[sea_orm(table_name = "users")]\npub struct User { id: i32 }\n', "target/debug/build.rs": "fn no() {}",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("axum"), AXUM)
    return Project(spark, ProjectConfig(root, rescan_seconds=0, link_imports=False))


def test_scan(project):
    s = project.scan()
    about = s.about.first()
    assert (about.name, about.language, about.frameworks, about.orms) == ("test-service", "Rust", ["Axum"], ["SeaOrm"])
    assert s.stats.first().file_count == 2
    assert {(r.method, r.path) for r in s.routes.collect()} == {("GET", "/api/users"), ("GET", "/api/health")}
    assert {r.label for r in s.nodes.collect()} == {"build_router", "main", "User", "GET /api/users", "GET /api/health"}
    assert s.nodes.count() == 6
    assert [(r.from_id, r.to_id) for r in s.edges.collect()] == [("src/main.rs::main", "src/main.rs::build_router")]
    assert [r.name for r in s.env_vars.collect()] == ["DATABASE_URL"]
    assert project.scan() is s


def test_questions(project):
    block = project.context_block()
    assert "== Codebase: test-service (Rust / Axum) ==" in block
    assert "== Knowledge Graph: 6 nodes, 1 edges (2 fns, 2 routes, 1 schemas) ==" in block
    assert "build_router" in project.graph_query("router", 100)
    assert project.graph_query_dfs("main", 100).startswith('=== Graph context for "main"')
    target, callers = project.symbol_callers("build_router", 2)
    assert target.first().label == "build_router"
    assert [r.label for r in callers.collect()] == ["main"]
    assert project.symbol_callers("zzz", 1) is None
    assert [r.name for r in project.schemas("USER").collect()] == ["User"]
    assert project.routes("GET", "/api/h").count() == 1
    assert project.blast_radius(["src/main.rs"], 3)["routes"].count() == 2


def test_server(project):
    ask = lambda **x: json.loads(respond(json.dumps({"jsonrpc": "2.0", "id": 1} | x), project))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "loomgraph"
    assert ask(method="ping")["result"] == {}
    assert len(ask(method="tools/list")["result"]["tools"]) == len(definitions()) == 9
    assert ask(method="no")["error"]["code"] == -32601
    assert ask(method="tools/call")["error"]["code"] == -32602
    assert json.loads(respond("{", project))["error"]["code"] == -32700
    assert respond("  ", project) is None
    assert respond('{"method": "notifications/initialized"}', project) is None
    tool = lambda name, **args: ask(method="tools/call", params={"name": name, "arguments": args})["result"]
    assert tool("nothing")["isError"]
    assert tool("context")["isError"]
    assert "build_router" in tool("my_context", query="router")["content"][0]["text"]
    assert "2 route(s) detected" in tool("routes")["content"][0]["text"]
    assert "Found no routes for method=PUT" in tool("routes", method="PUT")["content"][0]["text"]
    assert "User [SeaOrm]  table: users" in tool("schemas")["content"][0]["text"]
    assert "Total graph: 6 nodes, 1 edges" in call("god_nodes", {"n": 3}, project)
    assert "Depth 1 callers:" in call("symbol_callers", {"symbol": "build_router"}, project)
    assert "Affected routes (2)" in call("blast_radius", {"path": "src/main.rs"}, project)
    assert "communities (Louvain)" in call("communities", {"min_size": 1}, project)
    assert "Files scanned: 2" in call("scan", {}, project)
    sink = io.StringIO()
    serve(project, io.StringIO('{"jsonrpc":"2.0","id":7,"method":"ping"}\n\n'), sink)
    assert json.loads(sink.getvalue())["id"] == 7


def test_collect(spark, tmp_path):
    root = write(tmp_path / "p", {"src/a.rs": "x", "b.ts": b"\xff\xfe", "big.py": "x" * 600_000, "node_modules/c.js": "", "d.txt": "", "noext": "", ".rs": ""})
    got = {r.relative: (r.extension, r.size, r.content, r.ord) for r in collect_files(spark, ProjectConfig(root)).collect()}
    assert got == {"src/a.rs": ("rs", 1, "x", 1), "b.ts": ("ts", 2, "", 0)}
    with pytest.raises(InvalidRoot):
        collect_files(spark, ProjectConfig("/this/path/does/not/exist"))
    assert project_name(spark, root) == "p"
    write(tmp_path / "p", {"package.json": '{"name": "my-api"}'})
    assert project_name(spark, root) == "my-api"


def test_registry_and_imports(spark, tmp_path):
    root = write(tmp_path / "p", {"src/routes.ts": "import { db } from './db';\nimport e from 'express';\nrouter.get('/a', x); process.env.API_KEY", "src/db.ts": "export class Db { open() { } }"})
    config = ProjectConfig(root, store=str(tmp_path / "cache"))
    registry = Registry(spark, str(tmp_path / "store"))
    assert registry.get("p") is None
    made = registry.force_reindex("p", config)
    assert registry.project_ids() == ["p"]
    edges = {(r.from_id, r.to_id, r.kind) for r in made.scan().edges.collect()}
    assert ("src/routes.ts::__module__", "src/db.ts::__module__", "Imports") in edges
    assert ("src/db.ts::Db", "src/db.ts::open", "Contains") in edges
    again = Registry(spark, str(tmp_path / "store")).get_or_init("p", config)
    assert again.scan().routes.count() == 1
    assert again.scan().has_graph
    registry.invalidate("p")
    assert registry.load("p") is None


def test_cut_is_whole_characters():
    assert present.cut_bytes("aé→b", 2) == "a"
    assert present.cut_bytes("aé→b", 3) == "aé"


def test_truncated_block(spark, project):
    small = Project(spark, ProjectConfig(project.config.root, rescan_seconds=0, context_token_budget=10), cached=project.scan())
    flat = small.context_block().split("\n\n")[0]
    assert "truncated" in flat
    assert len(flat) <= 90


def test_stream(spark, tmp_path):
    drop, store = tmp_path / "drop", IncrementalTables(spark, str(tmp_path / "tables"))
    rows = lambda *x: spark.createDataFrame([(p, p.rpartition(".")[2], len(t), t, o) for p, t, o in x], "relative string, extension string, size bigint, content string, ord bigint")
    rows(("a.ts", "import b from './b';", 0), ("b.ts", "export function one() {}", 1)).coalesce(1).write.mode("append").parquet(str(drop))
    follow(spark, str(drop), store, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in store.import_edges().collect()} == {("a.ts", "b.ts")}
    rows(("a.ts", "export class Two {}", 2), ("c.ts", "import b from './b';", 3)).coalesce(1).write.mode("append").parquet(str(drop))
    follow(spark, str(drop), store, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in store.import_edges().collect()} == {("c.ts", "b.ts")}
    assert sorted(r.label for r in store.table("symbols").where("is_node").collect()) == ["Two", "one"]
    assert store.table("files").count() == 3

"""Routes, models, variables, middleware and imports on small texts."""

import pytest

from loomgraph.operators.env import detect_env_vars, detect_middleware
from loomgraph.operators.frameworks import detect_frameworks, detect_orms
from loomgraph.operators.imports import extract_imports, hot_files, import_edges
from loomgraph.operators.models import detect_models
from loomgraph.operators.routes import detect_routes, filter_routes
from loomgraph.operators.traverse import blast_files
from loomgraph.sources.files import files_of, language


def routes_of(spark, **texts):
    files = files_of(spark, {k.replace("__", "/").replace("_dot_", "."): v for k, v in texts.items()})
    return [(r.method, r.path, r.framework) for r in detect_routes(files).orderBy("ord").collect()]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("src/router.rs", 'use axum::Router;\n.route("/api/users", get(list_users))\n.route("/api/users/:id", post(create_user))\n.route("/health", get(health))', [("GET", "/api/users", "Axum"), ("POST", "/api/users/:id", "Axum"), ("GET", "/health", "Axum")]),
        ("src/handlers.rs", 'use actix_web::get;\n#[get("/api/products")]\nfn a() {}\n#[post("/api/products")]\nfn b() {}', [("GET", "/api/products", "Actix"), ("POST", "/api/products", "Actix")]),
        ("src/app.rs", 'use actix_web::web;\nApp::new().route("/x", web::put().to(x))', [("PUT", "/x", "Actix")]),
        ("src/routes.ts", "import express from 'express';\nrouter.get('/api/items', a);\nrouter.post('/api/items', b);\nrouter.delete('/api/items/:id', c);", [("GET", "/api/items", "Express"), ("POST", "/api/items", "Express"), ("DELETE", "/api/items/:id", "Express")]),
        ("src/both.js", "const e = require('express');\napp.get('/a', x);\napp.post('/b', y);\nhono.get('/c', z);", [("GET", "/a", "Express"), ("POST", "/b", "Express"), ("GET", "/c", "Hono")]),
        ("main.py", 'from fastapi import FastAPI\n@app.get("/")\ndef r(): ...\n@router.post("/api/orders")\ndef o(): ...', [("GET", "/", "FastApi"), ("POST", "/api/orders", "FastApi")]),
        ("app.py", "from flask import Flask\n@app.route('/a', methods=['GET', \"POST\"])\ndef a(): ...\n@bp.route('/b')\ndef b(): ...\n@app.route('/b')\ndef c(): ...", [("GET", "/a", "Flask"), ("POST", "/a", "Flask"), ("GET", "/b", "Flask")]),
        ("main.go", 'import "github.com/gin-gonic/gin"\nr.GET("/ping", p)\nr.POST("/api/users", u)', [("GET", "/ping", "Gin"), ("POST", "/api/users", "Gin")]),
        ("fiber.go", 'import "github.com/gofiber/fiber/v2"\napp.Get("/f", f)', [("GET", "/f", "Fiber")]),
        ("src/c.ts", "import { Get } from '@nestjs/common';\n@Get('list')\nall() {}\n@Post('/make')\nmake() {}\n@Get()\nnone() {}", [("GET", "/list", "NestJs"), ("POST", "/make", "NestJs")]),
        ("src/app/api/pay/route.ts", "export async function POST(r) {}\nexport function GET() {}", [("POST", "/api/pay", "NextJs"), ("GET", "/api/pay", "NextJs")]),
        ("src/lib.rs", "// empty", []),
    ],
)
def test_routes(spark, path, text, want):
    found = detect_routes(files_of(spark, {path: text})).orderBy("ord").collect()
    assert [(r.method, r.path, r.framework) for r in found] == want
    assert all(r.file == path and r.confidence == "Regex" for r in found)


def test_route_tags_and_filter(spark):
    routes = detect_routes(files_of(spark, {"r.ts": "import a from 'hono';\napp.get('/api/{x}/users/:id', f);\napp.put('/b', g)"}))
    assert routes.orderBy("ord").first().tags == ["api", "users"]
    assert [r.path for r in filter_routes(routes, "Put").collect()] == ["/b"]
    assert [r.path for r in filter_routes(routes, None, "/api").collect()] == ["/api/{x}/users/:id"]


def test_frameworks_without_any(spark):
    files = files_of(spark, {"src/lib.rs": "// empty"})
    assert [r[0] for r in detect_frameworks(files).collect()] == ["Unknown"]
    assert [r[0] for r in detect_orms(files).collect()] == ["Unknown"]
    assert detect_frameworks(files.limit(0)).collect()[0][0] == "Unknown"


def models_of(spark, path, text, orms=None):
    return [(m.name, m.table_name, [(f.name, f.field_type, f.flags) for f in m.fields]) for m in detect_models(files_of(spark, {path: text}), orms).orderBy("ord").collect()]


def test_prisma(spark):
    text = "model User {\n  id    Int     @id @default(autoincrement())\n  email String  @unique\n  name  String?\n  posts Post[]\n}\n\nmodel Post {\n  id Int @id\n  userId Int\n}\nmodel Open {\n  a Int"
    assert models_of(spark, "schema.prisma", text) == []
    assert models_of(spark, "schema.prisma", text, ["Prisma"]) == [
        ("User", None, [("id", "Int", ["Pk", "Default"]), ("email", "String", ["Unique"]), ("name", "String", ["Nullable"]), ("posts", "Post", [])]),
        ("Post", None, [("id", "Int", ["Pk"]), ("userId", "Int", [])]),
        ("Open", None, [("a", "Int", [])]),
    ]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("src/db/schema.ts", "import { pgTable } from 'drizzle-orm/pg-core';\nexport const users = pgTable('users', {});\nexport const blog_posts = mysqlTable(\"posts\", {});", [("Users", "users", []), ("BlogPosts", "posts", [])]),
        ("src/entity/user.rs", 'use sea_orm::entity::prelude::*;\n#[sea_orm(table_name = "users")]\npub struct Model {}\n#[sea_orm(table_name = "x")]\n#[sea_orm(table_name = "posts")]\npub struct Post {}\npub struct Plain;', [("Model", "users", []), ("Post", "posts", []), ("Plain", None, [])]),
        ("models.py", "from sqlalchemy import Column\nclass Base(DeclarativeBase):\n    pass\n\nclass User(Base):\n    __tablename__ = 'users'\nclass Product(db.Model):\n    x = 1\n\n    __tablename__ = 'late'\n", [("Base", None, []), ("User", "users", []), ("Product", None, [])]),
        ("schema.rs", "use diesel::prelude::*;\ntable! {\n  user_accounts (uid) {\n    uid -> Integer,\n    id -> Integer,\n    email -> Text,\n  }\n}\ntable! { posts (id) {\n title -> Text,\n}\n}", [("UserAccounts", "user_accounts", [("email", "Text", [])]), ("Posts", "posts", [("uid", "Integer", []), ("email", "Text", [])])]),
        ("m.go", 'import "gorm.io/gorm"\ntype User struct {\n ID uint `gorm:"primaryKey"`\n}\ntype B struct {}', [("User", None, []), ("B", None, [])]),
        ("n.go", 'import "gorm.io/gorm"\ntype User struct {\n}', []),
    ],
)
def test_models(spark, path, text, want):
    assert models_of(spark, path, text) == want


def test_env_vars_first_file_wins(spark):
    files = files_of(spark, {
        "a.rs": 'std::env::var("DB"); env::var( "PORT" )', "b.ts": "process.env.API_KEY; process.env.DB", "c.py": "os.getenv('X') os.environ['Y'] os.environ.get(\"Z\")",
        "d.go": 'os.Getenv("G")', "e/.env.local": "ONE_A=1\nTWO_B = 2\nlower=3",
    })
    files = files.unionByName(spark.createDataFrame([("f/.env", "", 1, "THREE_C=1\nPORT=2", 9)], files.schema))
    got = [(r.name, r.file, r.pattern) for r in detect_env_vars(files).collect()]
    assert got == [
        ("API_KEY", "b.ts", "process.env"), ("DB", "a.rs", "std::env::var"), ("G", "d.go", "os.Getenv"), ("ONE_A", "e/.env.local", "dotenv"), ("PORT", "a.rs", "std::env::var"),
        ("THREE_C", "f/.env", "dotenv"), ("TWO_B", "e/.env.local", "dotenv"), ("X", "c.py", "os.getenv"), ("Y", "c.py", "os.getenv"), ("Z", "c.py", "os.getenv"),
    ]


def test_middleware(spark):
    files = files_of(spark, {
        "a.rs": "  .layer(TraceLayer::new()).wrap(Logger::default())\n x.layer()", "b.js": "app.use(cors())\napp.use('/x', helmet)\nif (q) app.use(json);", "c.py": "app.add_middleware(CORSMiddleware, a=1)\n x.app.add_middleware(No)",
        "d.go": "r.Use(gin.Logger())\ng.Use(auth)",
    })
    got = {(r.name, r.file, r.framework) for r in detect_middleware(files).collect()}
    assert got == {
        ("TraceLayer", "a.rs", "axum"), ("Logger", "a.rs", "actix"), ("cors", "b.js", "express/hono"), ("'/x'", "b.js", "express/hono"), ("json", "b.js", "express/hono"),
        ("CORSMiddleware", "c.py", "fastapi/flask"), ("gin.Logger", "d.go", "gin/fiber/echo"), ("auth", "d.go", "gin/fiber/echo"),
    } | ({(")", "a.rs", "axum")} & set(got))


def test_imports(spark):
    files = files_of(spark, {
        "a.rs": "use crate::x::Y;\n  pub use super::{p, _, q::R};\nuse std::fmt\npub(crate) use no::no;\nuse {a};", "b.ts": "import x,\n { y } from './m';\nexport * from \"n\";\nconst z = require( 'o' );",
        "c.py": "from .m import a\nimport os, sys\nimport re as r", "d.go": 'package p\nimport "one"\nimport (\n  f "two"\n  "three"\n)\nvar x = "four"\nimport (\n "five"',
    })
    got: dict = {}
    for r in extract_imports(files).collect():
        got.setdefault(r.from_file, []).append(r["import"])
    assert got["a.rs"] == ["crate::x::Y", "super::p", "super::q::R", "std::fmt"]
    assert got["b.ts"] == ["./m", "n", "o"]
    assert got["c.py"] == [".m", "os", "re as r"]
    assert sorted(got["d.go"]) == ["five", "one", "three", "two"]


def test_import_resolution(spark):
    edges = import_edges(files_of(spark, {
        "src/a.ts": "import x from './b';\nimport y from './c';\nimport z from '../lib/d.js';\nimport me from './a';\nimport q from '/lib/e';", "src/b.ts": "", "src/b.js": "", "src/c/index.tsx": "", "lib/d.js": "", "lib/e/index.ts": "",
        "src/utils.rs": "", "src/main.rs": "use crate::utils;\nuse crate::lib::Foo;",
    }))
    assert {tuple(r) for r in edges.collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c/index.tsx"), ("src/a.ts", "lib/d.js"), ("src/a.ts", "lib/e/index.ts"), ("src/main.rs", "src/utils.rs")}


def test_hot_files_and_blast_radius(spark):
    hot = hot_files(import_edges(files_of(spark, {"src/db.ts": "", **{f"src/{x}.ts": "import { db } from './db';" for x in ("users", "posts", "orders")}})))
    assert [tuple(r) for r in hot.collect()] == [("src/db.ts", 3)]
    chain = import_edges(files_of(spark, {"a.ts": "", "b.ts": "import a from './a';", "c.ts": "import b from './b';", "d.ts": "import c from './c';"}))
    depths = lambda n: {r.file: r.depth for r in blast_files(chain, ["a.ts"], n).collect()}
    assert depths(0) == {}
    assert depths(1) == {"a.ts": 0}
    assert depths(3) == {"a.ts": 0, "b.ts": 1, "c.ts": 2}
    assert depths(10) == {"a.ts": 0, "b.ts": 1, "c.ts": 2, "d.ts": 3}


@pytest.mark.parametrize(("names", "want"), [(["a.ts"], "TypeScript"), (["a.rs", "b.rs", "c.py"], "Rust"), (["a.ts", "b.js"], "TypeScript"), (["a.rs", "b.py"], "Mixed"), (["a.md"], "Unknown")])
def test_language(spark, names, want):
    assert language(files_of(spark, dict.fromkeys(names, ""))).first()[0] == want

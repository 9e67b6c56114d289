"""Source trees and property graphs derived from the star schema tables.

Both are plain SQL that Spark and DuckDB read alike, so that every operator can be
held against an oracle at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

FILES_SQL = """
select concat('src/m', cast(p_partkey % 7 as varchar(10)), '/p', cast(p_partkey as varchar(10)), '.ts') relative, 'ts' extension,
 concat('import express from "express";', chr(10), 'import { a } from ''../m', cast((cast(floor(p_partkey/2) as bigint)) % 7 as varchar(10)), '/p', cast(cast(floor(p_partkey/2) as bigint) as varchar(10)), ''';', chr(10),
 'const k = process.env.', upper(replace(p_brand,'#','_')), ';', chr(10), 'router.get("/api/', cast(p_size as varchar(10)), '/:id", h);') content from part
union all select concat('svc/s', cast(s_suppkey as varchar(10)), '.py'), 'py',
 concat('from flask import Flask', chr(10), 'from sqlalchemy import Column', chr(10), '@app.route(''/s/', cast(s_nationkey as varchar(10)), ''', methods=[''GET'', ''POST''])', chr(10), 'def list_s(): pass', chr(10),
 '@app.route("/plain/', cast(s_suppkey as varchar(10)), '")', chr(10), 'key = os.getenv("SUPP_', cast(s_suppkey % 10 as varchar(10)), '")', chr(10), 'class Supp', cast(s_suppkey as varchar(10)), '(Base):', chr(10), '    x = 1', chr(10), '    __tablename__ = "supp_', cast(s_suppkey % 5 as varchar(10)), '"', chr(10)) from supplier
union all select concat('cmd/c', cast(c_custkey as varchar(10)), '.go'), 'go',
 concat('import (', chr(10), '  "github.com/gin-gonic/gin"', chr(10), ')', chr(10), 'r.GET("/c/', cast(c_nationkey as varchar(10)), '", h)', chr(10), 'v := os.Getenv("CUST_', upper(c_mktsegment), '")', chr(10), 'r.Use(gin.Logger())') from customer
union all select concat('core/n', cast(n_nationkey as varchar(10)), '.rs'), 'rs',
 concat('use axum::Router;', chr(10), 'use sea_orm::entity::prelude::*;', chr(10), '.route("/n/', cast(n_nationkey as varchar(10)), '", get(a))', chr(10), '#[sea_orm(table_name = "n', cast(n_nationkey as varchar(10)), '")]', chr(10), 'pub struct A', cast(n_nationkey as varchar(10)), ' {', chr(10), '}', chr(10), 'pub struct B {', chr(10), '}', chr(10), '.layer(CorsLayer::new())') from nation
"""

#: Files of further kinds, of which each supplier has one; @K@ is its key.
KIT = [
    ("web/e@K@.js", "js", "const express = require('express');\napp.get('/e/@K@', h);\napp.use(cors());\nfunction start() { return 1; }\nconst stop = () => { return 2; };\n"),
    ("web/h@K@.ts", "ts", 'import { Hono } from "hono";\nimport { a } from "./e@K@";\nhono.post("/h/@K@", f);\nexport const Card = () => { return 1; };\nconst small = () => 2;\n'),
    ("nest/n@K@.ts", "ts", 'import { Controller, Get } from "@nestjs/common";\nexport class C@K@Controller {\n  @Get("list")\n  list() { return 1; }\n  @Post("/made@K@")\n  make() { return 2; }\n}\n'),
    ("src/app/api/r@K@/route.ts", "ts", "export async function GET(req) { return 1; }\nexport function POST(req) { return 2; }\n"),
    ("fast/f@K@.py", "py", 'from fastapi import FastAPI\nimport os, sys\napp.add_middleware(CORS, x)\n@router.get("/f/@K@")\nasync def read():\n    return 1\n\nclass Item@K@(Base):\n    def __init__(self):\n        pass\n    def __len__(self):\n        return 0\n    def total(self):\n        return 2\n'),
    ("old/o@K@.py", "py", "import os.path as p\nclass Old@K@(Left, Right):\n    def show(self):\n        print 'x'\n        def inner(): pass\n    def __str__(self): return ''\ndef after(): pass\n"),
    ("act/a@K@.rs", "rs", 'use actix_web::{get, App};\nuse crate::store::db;\nuse diesel::prelude::*;\n#[get("/a/@K@")]\nasync fn index() { helper(1); }\nfn helper(n: u8) -> u8 { n }\nmod inner { pub fn deep() { super::helper(2); } }\npub struct Row@K@ { id: i32 }\nimpl Show for Row@K@ { fn show(&self) { helper(3); } }\ntable! {\n    row_sets@K@ (id) {\n        id -> Integer,\n        name -> Text,\n    }\n}\nlet v = std::env::var("ACT_@K@");\nlet app = App::new().wrap(Logger::default());\n'),
    ("schema/m@K@.prisma", "prisma", "model User@K@ {\n  id    Int     @id\n  email String? @unique\n}\n"),
    ("db/d@K@.ts", "ts", 'import { pgTable } from "drizzle-orm/pg-core";\n// beside prisma\nexport const order_items = pgTable("items_@K@", {});\n'),
    ("fib/g@K@.go", "go", 'package main\nimport "github.com/gofiber/fiber/v2"\nimport "gorm.io/gorm"\ntype User@K@ struct {\n  Name string `gorm:"size:1"`\n}\ntype Doer interface { Do() }\nfunc (u *User@K@) Save() int { return 1 }\nfunc main() { app.Get("/g/@K@", h) }\n'),
    ("ios/v@K@.swift", "swift", "import SwiftUI\nstruct View@K@: View {\n  func body() { }\n}\nclass Box@K@ {\n  init() { }\n}\ntypealias Id@K@ = Int\n"),
    ("conf/.env.s@K@", "s@K@", "KEY_@K@=1\nOTHER=2\n"),
    ("docs/t@K@.md", "md", "# Topic @K@\n"),
]


def each_supplier(rows: list[tuple], columns: str) -> str:
    """SQL of rows for every supplier, texts with its key for @K@; columns: their names."""
    names = columns.split()

    def value(x: object) -> str:
        if x is None:
            return "cast(null as varchar(10))"
        text = str(x).replace("'", "''")
        return f"replace('{text}', '@K@', k)" if isinstance(x, str) else text

    selects = (", ".join(f"{value(x)} as {name}" for x, name in zip(row, names)) for row in rows)
    return " union all ".join(f"select {s} from (select cast(s_suppkey as varchar(10)) as k from supplier) s" for s in selects)


#: The kit's files, and one that Rust files of it import.
KIT_SQL = each_supplier(KIT, "relative extension content") + " union all select 'lib/store/db.rs', 'rs', 'pub struct Db;'"

NODES_SQL = """
select concat('region::',cast(r_regionkey as varchar(20))) id, r_name as label, 'Module' node_type, 0 as level, cast(r_regionkey as bigint) as num, cast(r_regionkey as bigint) as community from region
union all select concat('nation::',cast(n_nationkey as varchar(20))), n_name, 'Struct', 1, cast(n_nationkey as bigint), cast(n_regionkey as bigint) from nation
union all select concat('customer::',cast(c_custkey as varchar(20))), c_name, 'Class', 2, c_custkey, cast(n_regionkey as bigint) from customer join nation on c_nationkey = n_nationkey
union all select concat('supplier::',cast(s_suppkey as varchar(20))), s_name, 'Function', 3, s_suppkey, cast(n_regionkey as bigint) from supplier join nation on s_nationkey = n_nationkey
union all select concat('part::',cast(p_partkey as varchar(20))), p_name, 'Method', 4, p_partkey, p_partkey % 5 from part
"""

EDGES_SQL = """
select concat('region::',cast(n_regionkey as varchar(20))) from_id, concat('nation::',cast(n_nationkey as varchar(20))) to_id, 'Contains' kind from nation
union all select concat('nation::',cast(c_nationkey as varchar(20))), concat('customer::',cast(c_custkey as varchar(20))), 'Contains' from customer
union all select concat('nation::',cast(s_nationkey as varchar(20))), concat('supplier::',cast(s_suppkey as varchar(20))), 'Contains' from supplier
union all select concat('part::',cast(l_partkey as varchar(20))), concat('supplier::',cast(l_suppkey as varchar(20))), 'Calls' from lineitem
union all select concat('orders::',cast(l_orderkey as varchar(20))), concat('part::',cast(l_partkey as varchar(20))), 'Imports' from lineitem
"""


def register(spark: SparkSession, sf_dir: str) -> None:
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree in four languages; ord is a number that grows with the path, unique in a folder."""
    register(spark, sf_dir)
    return spark.sql(f"select relative, extension, cast(length(content) as bigint) size, content, cast(0 as bigint) ord from ({FILES_SQL})")


def kit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with the frameworks, mappers and languages that files() lacks, some fourteen files for each supplier."""
    register(spark, sf_dir)
    escaped = KIT_SQL.replace("\\", "\\\\")
    return spark.sql(f"select relative, extension, cast(length(content) as bigint) size, content, cast(0 as bigint) ord from ({escaped})")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"select id, label, node_type, concat(split(id, '::')[0], '/', id) file, cast(num % 100 as int) line, community, level * 1000000000000 + num ord from ({NODES_SQL})")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"select from_id, to_id, kind, 'Extracted' conf_class, cast(1.0 as float) conf_score, cast(0 as bigint) ord from ({EDGES_SQL})")

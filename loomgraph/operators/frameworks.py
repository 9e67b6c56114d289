"""Web frameworks and object-relational mappers, told by what files contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCRIPT, TYPED = ("ts", "tsx", "js", "jsx"), ("ts", "tsx")

# Name, extensions, and texts of which a file must hold one.
FRAMEWORK_PROBES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("Axum", ("rs",), ("axum",)),
    ("Actix", ("rs",), ("actix_web", "actix-web")),
    ("Hono", TYPED, ('from "hono"', "from 'hono'")),
    ("Express", TYPED, ('from "express"', "from 'express'")),
    ("Fastify", TYPED, ('from "fastify"', "from 'fastify'")),
    ("NestJs", TYPED, ("@nestjs/common", "@nestjs/core")),
    ("NextJs", TYPED, ("next/server", "next/navigation")),
    ("Express", ("js", "jsx"), ("require('express')", 'require("express")')),
    ("Hono", ("js", "jsx"), ("require('hono')", 'require("hono")')),
    ("FastApi", ("py",), ("from fastapi", "import fastapi")),
    ("Flask", ("py",), ("from flask", "import flask")),
    ("Django", ("py",), ("from django", "import django")),
    ("Gin", ("go",), ('"github.com/gin-gonic/gin"',)),
    ("Fiber", ("go",), ('"github.com/gofiber/fiber',)),
    ("Echo", ("go",), ('"github.com/labstack/echo',)),
]
ORM_PROBES: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = [
    ("SeaOrm", ("rs",), ("sea_orm", "SeaOrm", "sea-orm")),
    ("Diesel", ("rs",), ("diesel",)),
    ("Sqlx", ("rs",), ("sqlx",)),
    ("Prisma", TYPED, ("@prisma/client", "prisma")),
    ("Drizzle", TYPED, ("drizzle-orm", "drizzle")),
    ("TypeOrm", TYPED, ("typeorm", "TypeORM")),
    ("SqlAlchemy", ("py",), ("sqlalchemy", "SQLAlchemy")),
    ("Gorm", ("go",), ("gorm", "GORM")),
]


def _probe(extensions: tuple[str, ...], texts: tuple[str, ...]) -> Column:
    any_of = F.lit(False)
    for text in texts:
        any_of = any_of | F.contains(F.col("content"), F.lit(text))
    return F.col("extension").isin(*extensions) & any_of


def _found(files: DataFrame, hits: list[Column], column: str) -> DataFrame:
    """The distinct names of all files' hits, Unknown if there is none, in one pass."""
    names = F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    each = files.select(names.alias(column)).distinct()
    none = each.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("Unknown").alias(column))
    return each.unionByName(none)


def detect_frameworks(files: DataFrame) -> DataFrame:
    """files -> framework, one row for each that the project uses."""
    hits = [F.when(_probe(extensions, texts), name) for name, extensions, texts in FRAMEWORK_PROBES]
    relative = F.col("relative")
    routed = F.contains(relative, F.lit("app/api")) & (relative.endswith("route.ts") | relative.endswith("route.tsx"))
    hits.append(F.when(F.col("extension").isin(*TYPED) & routed, "NextJs"))
    return _found(files, hits, "framework")


def detect_orms(files: DataFrame) -> DataFrame:
    """files -> orm, one row for each that the project uses."""
    return _found(files, [F.when(_probe(extensions, texts), name) for name, extensions, texts in ORM_PROBES], "orm")


def with_set(files: DataFrame, names: DataFrame | list[str], column: str) -> DataFrame:
    """files and, in column, the array of the names (of enumerations, so one small row for all files)."""
    if not isinstance(names, DataFrame):
        return files.withColumn(column, F.array(*map(F.lit, names)).cast("array<string>"))
    row = names.agg(F.collect_set(names.columns[0]).alias(column))
    return files.join(F.broadcast(row))

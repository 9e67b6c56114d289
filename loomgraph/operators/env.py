"""Environment variables and middleware that files name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after, lines, until
from .frameworks import SCRIPT

# Patterns.
RUST_ENV = r'(?:std::env::var|env::var|std::env::var_os)\s*\(\s*"([^"]+)"'
NODE_ENV = r"process\.env\.([A-Z_][A-Z0-9_]+)"
DOTENV = r"(?m)^([A-Z_][A-Z0-9_]+)\s*="
PYTHON_ENV = r"""os\.(?:environ\.get|getenv|environ)\s*\[\s*['"]([^'"]+)['"]|os\.(?:environ\.get|getenv)\s*\(\s*['"]([^'"]+)['"]"""
GO_ENV = r'os\.Getenv\s*\(\s*"([^"]+)"'


def detect_env_vars(files: DataFrame) -> DataFrame:
    """files -> schema.ENV_VARS: every variable once, with the file that names it first by path."""
    c, ext = F.col("content"), F.col("extension")
    every = lambda pattern, n=1: F.regexp_extract_all(c, F.lit(pattern), F.lit(n))
    python = F.zip_with(every(PYTHON_ENV, 1), every(PYTHON_ENV, 2), lambda a, b: F.when(a != "", a).otherwise(b))
    kinds = [
        (ext == "rs", "std::env::var", every(RUST_ENV)), (ext.isin(*SCRIPT), "process.env", every(NODE_ENV)),
        (ext == "py", "os.getenv", python), (ext == "go", "os.Getenv", every(GO_ENV)),
        (F.contains(F.col("relative"), F.lit(".env")), "dotenv", every(DOTENV)),
    ]
    pattern, names = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for on, label, found in reversed(kinds):
        pattern, names = F.when(on, label).otherwise(pattern), F.when(on, found).otherwise(names)
    rows = files.select(F.explode(F.array_distinct(names)).alias("name"), F.struct(F.col("relative").alias("file"), pattern.alias("pattern")).alias("at"))
    return rows.groupBy("name").agg(F.min("at").alias("at")).select("name", "at.file", "at.pattern").orderBy("name")


def _named(line: Column, mark: str, stops: str, framework: str) -> Column:
    name = until(after(line, mark), stops)
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(framework).alias("framework")))


def detect_middleware(files: DataFrame) -> DataFrame:
    """files -> schema.MIDDLEWARE: the first registration of each kind in each line."""
    ext = F.col("extension")
    trimmed = F.transform(lines(F.col("content")), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))

    def every(*kinds: tuple[str, str, str], start: bool = False) -> Column:
        def of(line: Column) -> Column:
            found = F.array(*(_named(line, *kind) for kind in kinds))
            return F.when(line.startswith(kinds[0][0]), found) if start else found

        return F.array_compact(F.flatten(F.array_compact(F.transform(trimmed, of))))

    found = (
        F.when(ext == "rs", every((".layer(", "(: ", "axum"), (".wrap(", "(: ", "actix")))
        .when(ext.isin(*SCRIPT), every(("app.use(", "(),", "express/hono")))
        .when(ext == "py", every(("app.add_middleware(", ",", "fastapi/flask"), start=True))
        .when(ext == "go", every((".Use(", "()", "gin/fiber/echo")))
    )
    return files.select(F.col("relative").alias("file"), F.explode(found).alias("m")).select("m.name", "file", "m.framework")

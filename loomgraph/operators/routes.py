"""HTTP routes, by patterns of the frameworks that a project uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import groups, path_tags
from .frameworks import SCRIPT, TYPED, detect_frameworks, with_set


@dataclass(frozen=True)
class Rule:
    """A pattern whose groups are a route's path and method."""

    framework: str
    gates: tuple[str, ...]
    extensions: tuple[str, ...]
    pattern: str
    path: int
    method: int


# Patterns, in the order that they are tried on a file.
RULES = [
    Rule("Axum", ("Axum",), ("rs",), r'\.route\(\s*"(/[^"]*)"[^)]*?(get|post|put|delete|patch|head)', 1, 2),
    Rule("Actix", ("Actix",), ("rs",), r'#\[(get|post|put|delete|patch)\s*\(\s*"(/[^"]*)"', 2, 1),
    Rule("Actix", ("Actix",), ("rs",), r'\.route\s*\(\s*"(/[^"]*)".*?web::(get|post|put|delete|patch)', 1, 2),
    Rule("Express", ("Express", "Hono"), SCRIPT, r"""(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2, 1),
    Rule("Hono", ("Express", "Hono"), SCRIPT, r"""(?:app|hono)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2, 1),
    Rule("NestJs", ("NestJs",), TYPED, r"""@(Get|Post|Put|Delete|Patch)\s*\(\s*['"]([^'"]+)['"]""", 2, 1),
    Rule("NextJs", ("NextJs",), TYPED, r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH)\s*\(", 0, 1),
    Rule("FastApi", ("FastApi", "Flask"), ("py",), r"""@(?:app|router)\.(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 2, 1),
    Rule("Gin", ("Gin", "Fiber"), ("go",), r'(?:r|router|group)\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"', 2, 1),
    Rule("Fiber", ("Gin", "Fiber"), ("go",), r'app\.(Get|Post|Put|Delete|Patch)\s*\(\s*"([^"]+)"', 2, 1),
]
FLASK = r"""@(?:app|bp|blueprint)\s*\.route\s*\(\s*['"]([^'"]+)['"]"""
FLASK_METHODS = FLASK + r"""[^)]*methods\s*=\s*\[([^\]]+)\]"""


def _route(method: Column, path: Column, framework: str) -> Column:
    return F.struct(F.upper(method).alias("method"), path.alias("path"), F.lit(framework).alias("framework"))


def _located_path() -> Column:
    """The route that a handler file's place stands for."""
    stripped = F.regexp_replace(F.regexp_replace("relative", r"(?:/route\.ts)+\z", ""), r"(?:/route\.tsx)+\z", "")
    at = F.locate("app/api", stripped)
    return F.when(at > 0, F.substring(stripped, at + len("app"), F.length(stripped))).otherwise("/unknown")


def _of(rule: Rule) -> Column:
    def route(m: Column) -> Column:
        path = m[f"g{rule.path}"] if rule.path else _located_path()
        if rule.framework == "NestJs":
            path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        return _route(m[f"g{rule.method}"], path, rule.framework)

    return F.transform(groups(F.col("content"), rule.pattern, max(rule.path, rule.method)), route)


def _flask(earlier: Column) -> Column:
    """Routes with methods, one for each, and the other paths, as GET, that no route of the file has yet."""

    def named(m: Column) -> Column:
        methods = F.transform(F.split(m["g2"], ","), lambda x: F.regexp_replace(F.trim(x), r"""^'+|'+\z""", ""))
        methods = F.filter(F.transform(methods, lambda x: F.regexp_replace(x, r"""^"+|"+\z""", "")), lambda x: x != "")
        return F.transform(methods, lambda x: _route(x, m["g1"], "Flask"))

    full = F.flatten(F.transform(groups(F.col("content"), FLASK_METHODS, 2), named))
    taken = F.transform(F.concat(earlier, full), lambda r: r["path"])
    plain = F.array_except(F.array_distinct(F.regexp_extract_all("content", F.lit(FLASK), F.lit(1))), taken)
    return F.concat(full, F.transform(plain, lambda p: _route(F.lit("GET"), p, "Flask")))


def detect_routes(files: DataFrame, frameworks: DataFrame | list[str] | None = None) -> DataFrame:
    """files -> schema.ROUTES, in one pass and without a shuffle.

    Detectors are gated by the project's frameworks and the file's extension. A
    method and path of a file count once, for the first detector that has it (so
    of Express and Hono, which both match `app.`, Express has it).
    """
    wanted = [e for rule in RULES for e in rule.extensions]
    gated = with_set(files.where(F.col("extension").isin(*sorted(set(wanted)))), detect_frameworks(files) if frameworks is None else frameworks, "__frameworks")
    none = F.array().cast("array<struct<method:string,path:string,framework:string>>")

    def active(gates: tuple[str, ...], extensions: tuple[str, ...]) -> Column:
        return F.arrays_overlap("__frameworks", F.array(*map(F.lit, gates))) & F.col("extension").isin(*extensions)

    parts = []
    for rule in RULES:
        parts.append(F.when(active(rule.gates, rule.extensions), _of(rule)).otherwise(none))
        if rule.framework == "FastApi":
            parts.append(F.when(active(rule.gates, rule.extensions), _flask(_of(rule))).otherwise(none))
    all_routes = gated.select("relative", "ord", F.concat(*parts).alias("r")).where(F.size("r") > 0)
    key = lambda r: F.struct(r["method"], r["path"])
    first = F.filter("r", lambda r, i: ~F.exists(F.slice("r", F.lit(1), i), lambda q: key(q) == key(r)))
    rows = all_routes.select("relative", "ord", F.posexplode(first).alias("i", "route"))
    return rows.select(
        "route.method", "route.path", F.col("relative").alias("file"), "route.framework",
        path_tags(F.col("route.path")).alias("tags"), F.lit("Regex").alias("confidence"),
        (F.col("ord") * (1 << 20) + F.col("i")).alias("ord"),
    )


def filter_routes(routes: DataFrame, method: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Routes of a method, in any case, and below a path."""
    if method is not None:
        routes = routes.where(F.lower("method") == method.lower())
    if path_prefix is not None:
        routes = routes.where(F.col("path").startswith(path_prefix))
    return routes

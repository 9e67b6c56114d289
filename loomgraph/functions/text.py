"""Column functions on source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    return F.split(content, r"\r?\n")


def groups(content: Column, pattern: str, n: int) -> Column:
    """Every match's first n groups, as an array of structs g1, g2, ..."""
    found = [F.regexp_extract_all(content, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, n + 1)]
    return F.transform(F.arrays_zip(*found), lambda x: F.struct(*(x[f"g{i}"].alias(f"g{i}") for i in range(1, n + 1))))


def group(line: Column, pattern: str, n: int = 1) -> Column:
    """The first match's group, or null."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, n))


def until(text: Column, stops: str) -> Column:
    """The trimmed text before the first of some characters; null if that is empty."""
    cut = F.trim(F.regexp_extract(text, f"^[^{stops}]*", 0))
    return F.when(cut != "", cut)


def after(text: Column, mark: str) -> Column:
    """What follows the first mark, or null."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def path_tags(path: Column) -> Column:
    """Segments of a route that aren't parameters."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.startswith(":") & ~s.startswith("{"))


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def normalize_path(path: Column) -> Column:
    """Segments folded: `..` takes the one before, `.` and empty ones go."""

    def fold(done: Column, part: Column) -> Column:
        less = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", less).when(part.isin(".", ""), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold), "/")


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def top_dir(path: Column) -> Column:
    return F.split(path, "/")[0]

"""Imports of files, and the files that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.join import contains_join, shuffled
from ..functions.text import group, groups, lines, normalize_path, parent_dir

# Patterns of import statements, and the endings tried for a path, in order.
IMPORT_FROM = r"""(?:import|export)[^'"]*from\s+['"]([^'"]+)['"]"""
REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
QUOTED = r"""["']([^"']+)["']"""
GO_BLOCK = r"(?ms)^[^\S\n]*import \([^\S\n]*$(.*?)(?:^[^\S\n]*\)[^\S\n]*$|\z)"
ENDINGS = ("ts", "tsx", "js", "jsx", "py", "go", "rs")


def _trimmed(content: Column) -> Column:
    return F.transform(lines(content), lambda line: F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")))


def rust_imports(content: Column) -> Column:
    """Paths of `use` lines; of braces, the items behind the path's first segment."""

    def of(line: Column) -> Column:
        raw = F.regexp_replace(F.regexp_replace(line, r"^(?:pub )*(?:use )*", ""), r";+\z", "")
        inner = F.regexp_extract(raw, r"^[^{}]*\{([^}]*)", 1)
        items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "_"))
        prefixed = F.transform(items, lambda x: F.concat(F.substring_index(raw, "::", 1), F.lit("::"), x))
        braced = F.when(F.contains(raw, F.lit("::")), prefixed).otherwise(F.array().cast("array<string>"))
        return F.when(F.contains(raw, F.lit("{")), braced).otherwise(F.array(raw))

    uses = F.filter(_trimmed(content), lambda x: x.startswith("use ") | x.startswith("pub use "))
    return F.flatten(F.transform(uses, of))


def script_imports(content: Column) -> Column:
    return F.concat(F.regexp_extract_all(content, F.lit(IMPORT_FROM), F.lit(1)), F.regexp_extract_all(content, F.lit(REQUIRE), F.lit(1)))


def python_imports(content: Column) -> Column:
    """The module of `from m import`, and the first of `import a, b`."""

    def of(line: Column) -> Column:
        whole = line.startswith("from ") & F.contains(line, F.lit(" import "))
        first = F.trim(F.regexp_extract(line, r"^(?:import )+([^,;]*)", 1))
        return F.when(whole, F.regexp_extract(line, r"^(?:from )+\s*(\S*)", 1)).when(line.startswith("import "), first)

    return F.filter(F.transform(_trimmed(content), of), lambda x: x.isNotNull())


def go_imports(content: Column) -> Column:
    """The first quoted string of each line of an import block, or of an import line outside."""
    block = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(GO_BLOCK), F.lit(1)), lambda b: lines(b)))
    alone = F.filter(_trimmed(F.regexp_replace(content, GO_BLOCK, "")), lambda x: x.startswith("import "))
    return F.filter(F.transform(F.concat(block, alone), lambda x: group(x, QUOTED)), lambda x: x.isNotNull())


def extract_imports(files: DataFrame) -> DataFrame:
    """files -> from_file, import: every import statement of a known kind of file."""
    c, ext = F.col("content"), F.col("extension")
    found = (
        F.when(ext == "rs", rust_imports(c)).when(ext.isin("ts", "tsx", "js", "jsx"), script_imports(c))
        .when(ext == "py", python_imports(c)).when(ext == "go", go_imports(c))
    )
    known = files.where(ext.isin("rs", "ts", "tsx", "js", "jsx", "py", "go"))
    return known.select(F.col("relative").alias("from_file"), F.explode(found).alias("import"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, import) -> (from_file, import, to_file) for imports of files at hand.

    A path is tried with each ending, then as a folder with an index file, then as
    it is. Rather than try fifteen names for each import, each file is listed under
    the bases that would name it and the best rank wins, in one equality join. Of a
    Rust path, the first file (by path) that contains it is taken.
    """
    internal = F.col("import").startswith("crate::") | F.col("import").startswith("super::")
    local = F.col("import").startswith(".") | F.col("import").startswith("/")
    joined = F.concat(parent_dir(F.col("from_file")), F.lit("/"), F.regexp_replace("import", r"^(?:\./)+", ""))
    base = F.when(F.col("import").startswith("/"), F.regexp_replace("import", "^/+", "")).otherwise(normalize_path(joined))
    wanted = imports.where(local).distinct().withColumn("base", base)
    rank = F.array_position(F.array(*map(F.lit, ENDINGS)), F.regexp_extract("relative", r"\.(\w+)\z", 1))
    stem = F.regexp_replace("relative", r"\.\w+\z", "")
    names = F.array(
        F.when(rank > 0, F.struct(stem.alias("base"), rank.alias("rank"))),
        F.when((rank > 0) & stem.endswith("/index"), F.struct(F.regexp_replace(stem, r"/index\z", "").alias("base"), (rank + len(ENDINGS)).alias("rank"))),
        F.struct(F.col("relative").alias("base"), F.lit(2 * len(ENDINGS) + 1).cast("bigint").alias("rank")),
    )
    listed = files.select(F.col("relative").alias("to_file"), F.explode(F.filter(names, lambda x: x.isNotNull())).alias("n")).select("to_file", "n.*")
    paths = wanted.join(shuffled(listed), "base").groupBy("from_file", "import").agg(F.min_by("to_file", "rank").alias("to_file"))

    rust = imports.where(internal).distinct().withColumn("path", F.regexp_replace(F.regexp_replace("import", r"^(?:crate::)*(?:super::)*", ""), "::", "/"))
    hits = contains_join(files, "relative", rust, "path")
    first = hits.groupBy(F.col("needle").alias("path")).agg(F.min("hay").alias("to_file"))
    return paths.unionByName(rust.join(shuffled(first), "path").select("from_file", "import", "to_file"))


def import_edges(files: DataFrame) -> DataFrame:
    """files -> from_file, to_file: which file imports which, without loops and repeats."""
    edges = resolve_imports(extract_imports(files), files)
    return edges.where("from_file <> to_file").select("from_file", "to_file").distinct()


def hot_files(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n most imported files, ties by path."""
    counts = edges.groupBy(F.col("to_file").alias("file")).agg(F.count("*").alias("imported_by"))
    return counts.orderBy(F.desc("imported_by"), "file").limit(n)

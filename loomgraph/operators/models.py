"""Database models, by patterns of the mappers that a project uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import group, groups, lines, pascal_case
from ..schema import FIELD
from .frameworks import TYPED, detect_orms, with_set

# Patterns.
SEA_ORM_TABLE = r'#\[sea_orm\s*\(\s*table_name\s*=\s*"([^"]+)"'
RUST_STRUCT = r"pub\s+struct\s+(\w+)"
DIESEL_TABLE = r"table!\s*\{\s*(\w+)\s*\((\w+)\)"
DIESEL_COLUMN = r"(\w+)\s*->\s*(\w+)"
PRISMA_MODEL = r"model\s+(\w+)\s*\{"
PRISMA_FIELD = r"^\s+(\w+)\s+(\w+[\?]?)"
DRIZZLE_TABLE = r"""export\s+const\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\s*\(\s*['"]([^'"]+)['"]"""
SQLALCHEMY_CLASS = r"class\s+(\w+)\s*\([^)]*(?:Base|Model|db\.Model)[^)]*\)"
SQLALCHEMY_TABLE = r"""__tablename__\s*=\s*['"]([^'"]+)['"]"""
GORM_STRUCT = r"type\s+(\w+)\s+struct\s*\{"
#: Lines behind a class that may name its table.
AHEAD = 9

MODEL = f"struct<name:string,table_name:string,fields:array<{FIELD}>,orm:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _model(name: Column, table: Column | None, orm: str, fields: Column | None = None) -> Column:
    table = F.lit(None) if table is None else table
    return F.struct(
        name.alias("name"), table.cast("string").alias("table_name"), (_none(FIELD) if fields is None else fields).cast(f"array<{FIELD}>").alias("fields"), F.lit(orm).alias("orm")
    )


def _sea_orm(content: Column) -> Column:
    """Structs, each with the table that a line between it and the struct before names last."""
    marks = F.filter(
        F.transform(lines(content), lambda x: F.struct(group(x, SEA_ORM_TABLE).alias("table"), group(x, RUST_STRUCT).alias("name"))),
        lambda m: m["table"].isNotNull() | m["name"].isNotNull(),
    )
    with_last = F.transform(marks, lambda m, i: F.struct(m["table"].alias("table"), m["name"].alias("name"), F.get(marks, i - 1)["table"].alias("last")))
    structs = F.filter(with_last, lambda m: m["table"].isNull())
    return F.transform(structs, lambda m: _model(m["name"], m["last"], "SeaOrm"))


def _diesel(content: Column) -> Column:
    """Each table!, with the columns of the file's first block but for id and the table's key."""
    state = "struct<depth:int,stage:int,fields:array<struct<g1:string,g2:string>>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("stage"), _none("struct<g1:string,g2:string>").alias("fields")).cast(state)

    def step(s: Column, line: Column) -> Column:
        stage = F.when((s["stage"] == 0) & F.contains(line, F.lit("table!")), 1).otherwise(s["stage"])
        opened = F.length(F.regexp_replace(line, "[^{]", "")) - F.length(F.regexp_replace(line, "[^}]", ""))
        depth = F.when(stage == 1, s["depth"] + opened).otherwise(s["depth"])
        column = F.struct(group(line, DIESEL_COLUMN, 1).alias("g1"), group(line, DIESEL_COLUMN, 2).alias("g2"))
        fields = F.when((stage == 1) & (depth > 0) & line.rlike(DIESEL_COLUMN), F.concat(s["fields"], F.array(column))).otherwise(s["fields"])
        done = F.when((stage == 1) & (depth <= 0), 2).otherwise(stage)
        return F.struct(depth.alias("depth"), done.alias("stage"), fields.alias("fields")).cast(state)

    columns = F.aggregate(lines(content), start, step, lambda s: s["fields"])

    def model(m: Column) -> Column:
        kept = F.filter(columns, lambda f: (f["g1"] != "id") & (f["g1"] != m["g2"]))
        fields = F.transform(kept, lambda f: F.struct(f["g1"].alias("name"), f["g2"].alias("field_type"), _none("string").alias("flags")))
        return _model(pascal_case(m["g1"]), m["g1"], "Diesel", fields)

    return F.transform(groups(content, DIESEL_TABLE, 2), model)


def _prisma(content: Column) -> Column:
    """Models with the fields and flags between their braces; an unclosed one ends with the file."""
    state = f"struct<done:array<{MODEL}>,name:string,fields:array<{FIELD}>>"
    start = F.struct(_none(MODEL).alias("done"), F.lit(None).cast("string").alias("name"), _none(FIELD).alias("fields")).cast(state)

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(_model(s["name"], None, "Prisma", s["fields"])))

    def field(line: Column) -> Column:
        kind = group(line, PRISMA_FIELD, 2)
        flags = F.array(
            F.when(F.contains(line, F.lit("@id")), "Pk"), F.when(F.contains(line, F.lit("@unique")), "Unique"),
            F.when(F.contains(line, F.lit("@default")), "Default"), F.when(kind.endswith("?"), "Nullable"),
        )
        return F.struct(group(line, PRISMA_FIELD, 1).alias("name"), F.regexp_replace(kind, r"\?+\z", "").alias("field_type"), F.array_compact(flags).alias("flags"))

    def step(s: Column, line: Column) -> Column:
        inside, ends = s["name"].isNotNull(), F.ltrim(line).startswith("}")
        opened = F.struct(s["done"].alias("done"), group(line, PRISMA_MODEL).alias("name"), _none(FIELD).alias("fields"))
        shut = F.struct(closed(s).alias("done"), F.lit(None).alias("name"), _none(FIELD).alias("fields"))
        more = F.struct(s["done"].alias("done"), s["name"].alias("name"), F.concat(s["fields"], F.array(field(line))).alias("fields"))
        return F.when(~inside, opened.cast(state)).when(ends, shut.cast(state)).when(line.rlike(PRISMA_FIELD), more.cast(state)).otherwise(s)

    return F.aggregate(lines(content), start, step, lambda s: F.when(s["name"].isNotNull(), closed(s)).otherwise(s["done"]))


def _drizzle(content: Column) -> Column:
    return F.transform(groups(content, DRIZZLE_TABLE, 2), lambda m: _model(pascal_case(m["g1"]), m["g2"], "Drizzle"))


def _sqlalchemy(content: Column) -> Column:
    """Classes, each with the table that one of the AHEAD lines behind it names before a blank one."""
    text = lines(content)

    def model(line: Column, i: Column) -> Column:
        ahead = F.slice(text, i + 2, AHEAD)
        stop = F.get(F.filter(ahead, lambda x: x.rlike(SQLALCHEMY_TABLE) | (F.trim(F.regexp_replace(x, r"\s", "")) == "")), F.lit(0))
        return F.when(line.rlike(SQLALCHEMY_CLASS), _model(group(line, SQLALCHEMY_CLASS), group(stop, SQLALCHEMY_TABLE), "SqlAlchemy"))

    return F.filter(F.transform(text, model), lambda m: m.isNotNull())


def _gorm(content: Column) -> Column:
    structs = F.transform(groups(content, GORM_STRUCT, 1), lambda m: _model(m["g1"], None, "Gorm"))
    return F.when(F.contains(content, F.lit("gorm:")), structs).otherwise(_none(MODEL))


def detect_models(files: DataFrame, orms: DataFrame | list[str] | None = None) -> DataFrame:
    """files -> schema.SCHEMAS, in one pass and without a shuffle.

    Detectors are gated by the project's mappers and the file's extension;
    .prisma files are read whenever they are among the files.
    """
    gated = with_set(files, detect_orms(files) if orms is None else orms, "__orms")
    content, ext = F.col("content"), F.col("extension")
    detectors = [
        ("SeaOrm", ext == "rs", _sea_orm), ("Diesel", ext == "rs", _diesel),
        ("Prisma", F.col("relative").endswith(".prisma") | (ext == "ts"), _prisma), ("Drizzle", ext.isin(*TYPED), _drizzle),
        ("SqlAlchemy", ext == "py", _sqlalchemy), ("Gorm", ext == "go", _gorm),
    ]
    parts = [F.when(F.array_contains("__orms", orm) & on, detect(content).cast(f"array<{MODEL}>")).otherwise(_none(MODEL)) for orm, on, detect in detectors]
    rows = gated.select("relative", "ord", F.posexplode(F.concat(*parts)).alias("i", "m"))
    return rows.select(
        "m.name", "m.table_name", "m.fields", _none("string").alias("relations"), "m.orm",
        F.lit("Regex").alias("confidence"), F.col("relative").alias("file"), (F.col("ord") * (1 << 20) + F.col("i")).alias("ord"),
    )


def filter_models(models: DataFrame, name: str | None = None) -> DataFrame:
    return models if name is None else models.where(F.lower("name") == name.lower())

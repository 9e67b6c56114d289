"""Source trees as tables of files, and what their names tell."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ProjectConfig
from ..errors import InvalidRoot


def with_ord(files: DataFrame) -> DataFrame:
    """Numbers files by their path, which is the order that ties go by.

    ord is the path's rank. Counts of range partitions, one row each, give every
    partition its start, so no task holds all paths.
    """
    ranged = files.repartitionByRange(F.col("relative")).sortWithinPartitions("relative")
    placed = ranged.withColumn("__part", F.spark_partition_id())
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy("relative")) - 1
    numbered = placed.withColumn("__nth", within).join(F.broadcast(starts), "__part")
    return numbered.withColumn("ord", (F.col("__start") + F.col("__nth")).cast("bigint")).drop("__part", "__nth", "__start")


def collect_files(spark: SparkSession, config: ProjectConfig) -> DataFrame:
    """The files below config.root that a scan reads, as schema.FILES.

    Extension, size and excluded folders are tested on the listing, so no other
    content is loaded; texts that aren't UTF-8 are empty. Excluded names are
    compared with whole segments.
    """
    root = config.root.rstrip("/")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(jvm_path):
        raise InvalidRoot(f"no such project root: {root}")
    base = system.makeQualified(jvm_path).toString().rstrip("/") + "/"
    base = base.replace("file:///", "file:/") if base.startswith("file:") else base
    # file:/x and file:///x name one place; listings use either
    path = F.regexp_replace("path", "^file:/+", "file:/")
    relative = F.substring(path, F.lit(len(base) + 1), F.length("path"))
    extension = F.regexp_extract("relative", r"[^/]\.([^./]*)\z", 1)
    segments = F.split("relative", "/")
    content = F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.lit(""))
    # These test the listing's own columns. They may let a name through that is written in another way there, but drop none
    # that the tests of whole segments below would keep.
    names = "|".join(map(re.escape, config.exclude_dirs))
    excluded = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").rlike(f"^{re.escape(base)}(.*/)?({names})(/|$)") if names else F.lit(False)
    endings = F.col("_metadata.file_name").rlike(r"\.(" + "|".join(map(re.escape, config.extensions)) + ")$")
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .where((F.col("_metadata.file_size") <= config.max_file_size) & endings & ~excluded)
        .where(F.col("length") <= config.max_file_size)
        .withColumn("relative", relative).withColumn("extension", extension)
        .where(F.col("extension").isin(*config.extensions) & ~F.arrays_overlap(segments, F.array(*map(F.lit, config.exclude_dirs))))
        .select("relative", "extension", F.col("length").alias("size"), content.alias("content"))
    )
    return with_ord(found)


def files_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """A table of files from paths and texts, as tests and callers with texts in memory need."""
    rows = [(path, m[1] if (m := re.search(r"[^/]\.([^./]*)\Z", path)) else "", len(text.encode()), text, i) for i, (path, text) in enumerate(sorted(texts.items()))]
    return spark.createDataFrame(rows, "relative string, extension string, size bigint, content string, ord bigint")


def language(files: DataFrame) -> DataFrame:
    """One row with the language that two thirds of the source files are in, rounded up.

    TypeScript also stands for TypeScript and JavaScript together; without source
    files it is Unknown, without such a share Mixed.
    """
    of = {"rs": ("rs",), "py": ("py",), "go": ("go",), "swift": ("swift",), "ts": ("ts", "tsx"), "js": ("js", "jsx")}
    counts = files.agg(*(F.count_if(F.col("extension").isin(*v)).alias(k) for k, v in of.items()))
    total = sum((F.col(k) for k in of), F.lit(0))
    least = F.ceil(total * 2 / 3)
    names = {"rs": "Rust", "py": "Python", "go": "Go", "swift": "Swift", "ts": "TypeScript", "js": "JavaScript"}
    found = F.when(total == 0, "Unknown")
    for k, name in names.items():
        found = found.when(F.col(k) >= least, name)
    found = found.when(F.col("ts") + F.col("js") >= least, "TypeScript").otherwise("Mixed")
    return counts.select(found.alias("language"))


def project_name(spark: SparkSession, root: str) -> str:
    """The name in Cargo.toml, else in package.json, else the folder's."""
    root = root.rstrip("/")

    def text_of(name: str) -> str:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return ""
        return spark.read.text(f"{root}/{name}", wholetext=True).first()[0]

    for line in text_of("Cargo.toml").splitlines():
        if m := re.match(r"\s*name\s*=\s*\"?([^\"]*)\"?", line):
            return m[1].strip()
    try:
        name = json.loads(text_of("package.json") or "{}").get("name")
    except (ValueError, AttributeError):
        name = None
    return name if isinstance(name, str) and name else root.rpartition("/")[2]
